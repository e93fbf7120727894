"""Personal data: four fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table made from templates (``labelled_table``) and decoded by Viterbi in
numpy batches.  A word whose score for "outside" beats any other by more than two transitions can ever regain
is outside on every best path, so the chain is cut there; what is left between cuts is decoded in batches.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import NOT_SPACE, Tokens, padded, slices, string_buffer

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: outside, the four kinds, and secrets (keys and access tokens).
LABELS = ("outside", *KINDS, "secret")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the four patterns in code points, leftmost and non-overlapping per kind; matches that fail their
    check are dropped without another try.  The forms used here equal the plain patterns: a local part starts at its
    run or after the last match, and an address at its digits' run, since a match always ends with a run."""
    emails, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            emails.append((begin, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    ips = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    cards = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            cards.append(m.span())
    phones = []
    if "+" in text:
        phones = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [emails, ips, cards, phones]


# ---- word shapes -------------------------------------------------------------------------------------------------

_CLASS = np.full(256, 8, dtype=np.int64)  # 0 lower or outside ASCII, 1 upper, 2 digit, 3 at, 4 dot, 5 dash, 6 bracket, 7 plus, 8 other
_CLASS[97:123] = _CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _k, _c in ((3, "@"), (4, "."), (5, "-_"), (6, "()"), (7, "+")):
    _CLASS[[ord(x) for x in _c]] = _k
_SIZE = np.digitize(np.arange(64), [2, 3, 5, 9, 13, 16, 20, 32])  # 9 classes of length
_DIGITS = np.digitize(np.arange(64), [1, 2, 3, 4, 5, 7, 9, 13, 20])  # 10 classes of digit counts
_RUNS = np.digitize(np.arange(64), [2, 3, 4, 6, 9])  # 6 classes of runs of one class
_BLOCKS = (512, 90, 50, 60, 81, 512, 512, 90, 90)
_OFFSETS = np.concatenate([[0], np.cumsum(_BLOCKS)])


def shapes(pad: np.ndarray, t: Tokens) -> np.ndarray:
    """Five shape codes per word: classes present, digits by length, dots by digits, runs by digits, first by last."""
    cls = _CLASS[pad]
    n = len(t.start)
    if not n:
        return np.zeros((0, 5), np.int64)
    bounds = np.stack([t.start, t.end], 1).ravel()
    bounds[-1] = min(bounds[-1], len(pad) - 1)
    present = np.bitwise_or.reduceat(1 << cls, bounds)[::2]
    digits = np.minimum(np.add.reduceat(cls == 2, bounds, dtype=np.int64)[::2], 63)
    dots = np.minimum(np.add.reduceat(cls == 4, bounds, dtype=np.int64)[::2], 4)
    turn = np.zeros(len(cls), bool)
    turn[1:] = cls[1:] != cls[:-1]
    turn[t.start] = False
    runs = np.minimum(np.add.reduceat(turn, bounds, dtype=np.int64)[::2] + 1, 63)
    size = np.minimum(t.end - t.start, 63)
    d = _DIGITS[digits]
    return np.stack([present, d * 9 + _SIZE[size], dots * 10 + d, _RUNS[runs] * 10 + d, cls[t.start] * 9 + cls[t.end - 1]], 1)


def features(pad: np.ndarray, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers per word (own shape, shape of both neighbours in the line) and whether a word starts a line."""
    own = shapes(pad, t)
    n = len(own)
    line = np.cumsum(pad == 10)[t.start] if n else np.zeros(0, np.int64)
    begins = np.ones(n, bool)
    if n > 1:
        row = t.row
        begins[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    before, after = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.int64)
    if n > 1:
        joined = ~begins[1:]
        before[1:][joined] = own[:-1][joined][:, :2]
        after[:-1][joined] = own[1:][joined][:, :2]
    codes = np.concatenate([own, before[:, :1], after[:, :1], before[:, 1:], after[:, 1:]], 1)
    return codes + _OFFSETS[:-1], begins


# ---- the field ---------------------------------------------------------------------------------------------------

#: Ordinary words of four languages, for the lines of the labelled table.
_WORDS = (
    "the a of and to in is for on with was this that from they have been were said when office report please send before meeting order paid Monday June "
    "le la les des est une pour dans avec nous vous lundi facture merci "
    "der die das und ist nicht mit auf wir bitte Rechnung Montag danke "
    "el los una que por para con factura lunes gracias").split()


def labelled_table(seed: int = 7, rows: int = 400) -> list[list[tuple[str, str]]]:
    """A small labelled table: lines of (word, label), made from templates with drawn words, values and decoys.

    Half of the words are ordinary ones, half are drawn from syllables; hosts, national forms of phone numbers, headers
    and assignments of secrets vary, so that the field goes by shapes and not by one source's habits.
    """
    rng = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es or nt ti st le de la que ver sch ción ment é ü".split()
    plain = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    word = lambda: (rng.choice(_WORDS) if rng.random() < 0.5 else plain()) + rng.choice(["", "", "", "", ",", "."])
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    tail = lambda x: x + rng.choice(["", "", "", "", ",", ".", ";", ")", "###", "!!", "%%%"])
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))

    def email():
        local = rng.choice([f"{plain()}.{digits(2)}", f"{plain()}.{plain()}", plain(), f"{plain()}_{plain()}", f"{plain()}+{plain()}", f"{plain()[:1]}{plain()}{digits(2)}"])
        host = rng.choice([f"{rng.choice(['mail', 'post'])}{digits(1)}.{rng.choice(['example', 'host'])}", plain(), f"{plain()}-{plain()}", f"{plain()}.{plain()}", f"dept.{plain()}"])
        return [(rng.choice(["", "", "<", "("]) + tail(f"{local}@{host}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io', 'edu'])}"), "email")]

    def ip():
        return [(rng.choice(["", "", "", "["]) + tail(".".join(str(rng.randint(1, 255)) for _ in range(4))), "ip")]

    def card():
        d = digits(16)
        if rng.random() < 0.5:
            return [(tail(d), "card")]
        if rng.random() < 0.3:
            return [(tail("-".join((d[:4], d[4:8], d[8:12], d[12:]))), "card")]
        return [(p, "card") for p in (d[:4], d[4:8], d[8:12], tail(d[12:]))]

    def phone():
        a, b = digits(3), digits(4)
        return rng.choice([
            lambda: [("+" + digits(1), "phone"), (f"({digits(3)})", "phone"), (tail(f"{a}-{b}"), "phone")],
            lambda: [("+" + digits(1), "phone"), (f"({digits(3)})", "phone"), (tail(f"{a}-{b}"), "phone")],
            lambda: [(f"({digits(3)})", "phone"), (tail(f"{a}-{b}"), "phone")],
            lambda: [(f"({digits(3)})", "phone"), (tail(f"{a}-{b}"), "phone")],
            lambda: [(tail(f"{digits(3)}-{a}-{b}"), "phone")],
            lambda: [(tail(f"{digits(3)}-{a}-{b}"), "phone")],
            lambda: [(tail(f"1-800-{a}-{b}"), "phone")],
            lambda: [(tail(f"{digits(3)}.{a}.{b}"), "phone")],
            lambda: [("+" + digits(2), "phone"), (digits(2), "phone"), (digits(4), "phone"), (tail(digits(4)), "phone")],
            lambda: [(tail(f"+{digits(2)}-{digits(2)}-{digits(7)}"), "phone")],
            lambda: [(tail(f"0{digits(3)}/{digits(7)}"), "phone")],
        ])()

    def secret():
        value = hexa(rng.choice([32, 40, 64])) if rng.random() < 0.6 else key(rng.randint(24, 44))
        name = rng.choice(["token", "key", "secret", "password", "api_key"])
        return rng.choice([
            lambda: [(name, "outside"), ("=", "outside"), (tail(f'"{value}"'), "secret")],
            lambda: [(name, "outside"), ("=", "outside"), (tail(f'"{value}"'), "secret")],
            lambda: [(name, "outside"), ("=", "outside"), (tail(value), "secret")],
            lambda: [(name + ":", "outside"), (tail(value), "secret")],
            lambda: [("Authorization:", "outside"), ("Bearer", "outside"), (value, "secret")],
            lambda: [(f'"{name}":', "outside"), (f'"{value}",', "secret")],
        ])()

    def decoy():
        return [(rng.choice([
            digits(rng.randint(1, 6)), f"20{digits(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
            f"${digits(2)}.{digits(2)}", f"{digits(1)}.{digits(2)}", word().upper().strip(",.") + "!!", word() + rng.choice(["###", "***", "$$$", "&&&", "%%%"]), "|", "=", "-",
            word().capitalize(), word().upper(), f"({word().strip('.,')})", f"{word().strip('.,')}-{word()}", f"{digits(2)}%", "http://" + word().strip(".,") + ".com/" + word(), digits(8),
            f"{word().strip('.,')}.{word()}", f"{digits(1)}.", "BY-NC", "4.0.", f"[{digits(1)}]", f"{digits(2)}:{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(2)}/{digits(2)}/{digits(4)}",
            f"v{digits(1)}.{digits(2)}", f"{digits(1)}-{digits(2)}", f"No.{digits(4)}", f"@{plain()}", f"{plain()}_{plain()}", f"{plain()}()", f"#{digits(4)}", f"{digits(3)}-{digits(3)}", f"{plain()}/{plain()}.py",
            f"{digits(3)},{digits(3)}", f"{plain()}=", "-->", f"<{plain()}>", f"{digits(1)},{digits(2)}"]), "outside")]

    makers = [email, ip, card, phone, secret]
    out = []
    for k in range(rows):
        parts = [[(word(), "outside")] for _ in range(rng.randint(4, 10))]
        parts.insert(rng.randint(0, len(parts)), makers[k % 5]())
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), decoy())
        out.append([x for p in parts for x in p])
    return out


class Field:
    """Weights of the features and transitions of a linear chain."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray):
        self.weights, self.trans = weights, trans
        other = trans[:, 1:] - trans[:, :1]
        onward = trans[1:, :] - trans[:1, :]
        self.regain = max(float(other.max()), 0.0) + max(float(onward.max()), 0.0)

    @classmethod
    def train(cls, table: list[list[tuple[str, str]]], steps: int = 150, rate: float = 0.08, decay: float = 2e-3) -> Field:
        """Maximum likelihood by forward and backward passes over all lines at once."""
        text = "\n".join(" ".join(w for w, _ in line) for line in table)
        pad = padded(np.frombuffer(text.encode(), np.uint8))
        t = Tokens(pad, np.array([0, len(pad) - 16]), NOT_SPACE)
        codes, _ = features(pad, t)
        gold = np.array([LABELS.index(x) for line in table for _, x in line])
        sizes = np.array([len(line) for line in table])
        first = np.cumsum(sizes) - sizes
        lines, longest, k = len(table), int(sizes.max()), len(LABELS)
        at = np.minimum(first[:, None] + np.arange(longest), len(gold) - 1)
        live = np.arange(longest) < sizes[:, None]
        weights, trans = np.zeros((_OFFSETS[-1], k)), np.zeros((k, k))
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, trans)]
        hot = np.eye(k)[gold]
        pairs = np.zeros((k, k))
        for a, s in zip(first, sizes):
            np.add.at(pairs, (gold[a:a + s - 1], gold[a + 1:a + s]), 1)
        for step in range(1, steps + 1):
            score = weights[codes].sum(1)
            e = np.where(live[:, :, None], score[at], 0.0)
            alpha, beta = np.zeros((longest, lines, k)), np.zeros((longest, lines, k))
            alpha[0] = e[:, 0]
            for i in range(1, longest):
                new = np.logaddexp.reduce(alpha[i - 1][:, :, None] + trans, axis=1) + e[:, i]
                alpha[i] = np.where(live[:, i, None], new, alpha[i - 1])
            for i in range(longest - 2, -1, -1):
                new = np.logaddexp.reduce(trans[None] + (e[:, i + 1] + beta[i + 1])[:, None, :], axis=2)
                beta[i] = np.where(live[:, i + 1, None], new, 0.0)
            norm = np.logaddexp.reduce(alpha[-1], axis=1)
            given = np.exp(alpha + beta - norm[None, :, None]).transpose(1, 0, 2)
            flat = given[live]
            expect = np.zeros((k, k))
            for i in range(1, longest):
                both = alpha[i - 1][:, :, None] + trans + (e[:, i] + beta[i])[:, None, :] - norm[:, None, None]
                expect += np.exp(both[live[:, i]]).sum(0)
            grad_w = np.zeros_like(weights)
            for j in range(codes.shape[1]):
                np.add.at(grad_w, codes[:, j], hot - flat)
            for x, g, (m, v) in zip((weights, trans), (grad_w / lines - decay * weights, (pairs - expect) / lines - decay * trans), state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x += rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        return cls(weights, trans)

    def decode(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Labels of the best path of every line."""
        n = len(codes)
        score = self.weights[codes[:, 0]]
        for j in range(1, codes.shape[1]):
            score += self.weights[codes[:, j]]
        labels = np.zeros(n, np.int64)
        open_ = score[:, 0] - score[:, 1:].max(1) <= self.regain if n else np.zeros(0, bool)
        at = np.flatnonzero(open_)
        if not len(at):
            return labels
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | begins[at[1:]]
        starts = at[np.flatnonzero(new)]
        sizes = np.diff(np.append(np.flatnonzero(new), len(at)))
        after = starts + sizes
        left = ~begins[starts]  # a word before it in the line, which is outside
        right = (after < n) & ~begins[np.minimum(after, n - 1)]
        for size in np.unique(1 << np.ceil(np.log2(sizes)).astype(np.int64)):
            group = np.flatnonzero((sizes <= size) & (sizes > size // 2))
            self._viterbi(score, labels, starts[group], sizes[group], left[group], right[group])
        return labels

    def _viterbi(self, score, labels, starts, sizes, left, right):
        lanes, longest = len(starts), int(sizes.max())
        best = score[starts] + np.where(left[:, None], self.trans[0], 0.0)
        back = np.zeros((longest, lanes, len(LABELS)), np.int8)
        everyone = np.arange(lanes)
        for i in range(1, longest):
            live = sizes > i
            step = best[:, :, None] + self.trans
            back[i] = step.argmax(1)
            new = step.max(1) + score[np.where(live, starts + i, 0)]
            best = np.where(live[:, None], new, best)
        label = (best + np.where(right[:, None], self.trans[:, 0], 0.0)).argmax(1)
        for i in range(longest - 1, -1, -1):
            live = sizes > i
            labels[starts[live] + i] = label[live]
            if i:
                label = np.where(live, back[i][everyone, label], label)


_EDGE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def _field_spans(field: Field, pad: np.ndarray, t: Tokens) -> dict[int, list[tuple[str, int, int]]]:
    """Byte spans of every row that the field labels, without the marks around them."""
    codes, begins = features(pad, t)
    labels = field.decode(codes, begins)
    at = np.flatnonzero(labels)
    found: dict[int, list[tuple[str, int, int]]] = {}
    if not len(at):
        return found
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | begins[at[1:]] | (labels[at[1:]] != labels[at[:-1]])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    rows = np.searchsorted(t.first, at[heads], "right") - 1
    for r, a, b in zip(rows.tolist(), at[heads].tolist(), at[tails].tolist()):
        kind, s, e = LABELS[labels[a]], int(t.start[a]), int(t.end[b])
        keep = _EDGE | frozenset(b"+(") if kind == "phone" else _EDGE
        while s < e and pad[s] not in keep:
            s += 1
        while e > s and pad[e - 1] not in _EDGE:
            e -= 1
        if e > s:
            found.setdefault(r, []).append((kind, s, e))
    return found


def _joined(spans) -> list[tuple[int, int]]:
    """Spans in order, those that meet joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def find(column: pa.Array, field: Field) -> list[tuple[list[list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """Per text: base spans by kind, and the field's spans that meet no base span, both in code points."""
    buf, offsets = string_buffer(column)
    out = []
    for lo, hi in slices(offsets):
        own = buf[offsets[lo]:offsets[hi]]
        o = offsets[lo:hi + 1] - offsets[lo]
        pad = padded(own)
        t = Tokens(pad, o, NOT_SPACE)
        extra = _field_spans(field, pad, t)
        sums = np.zeros((2, len(own) + 1), np.int64)
        np.cumsum((own >= 48) & (own < 58), out=sums[0, 1:])
        np.cumsum(own == 64, out=sums[1, 1:])
        digits, ats = (x[o[1:]] - x[o[:-1]] for x in sums)
        points = np.concatenate([[0], np.cumsum(own & 0xC0 != 0x80)])  # code points ahead of every byte
        for r in range(hi - lo):
            # No address, card or phone has fewer than four digits, and no mail address lacks an @.
            if digits[r] < 4 and not ats[r] and r not in extra:
                out.append(([[], [], [], []], []))
                continue
            data = own[o[r]:o[r + 1]].tobytes()
            base = base_spans(data.decode("utf-8", "replace"))
            taken = _joined(s for kind in base for s in kind)
            added = []
            for kind, s, e in extra.get(r, ()):
                s, e = int(points[s] - points[o[r]]), int(points[e] - points[o[r]])
                k = bisect_right(taken, (s, s))  # the first that begins after s; the one ahead may reach over it
                if not (k < len(taken) and taken[k][0] < e) and not (k and taken[k - 1][1] > s):
                    added.append((kind, s, e))
            out.append((base, added))
    return out


def personal_data(docs: DataFrame, table: list[list[tuple[str, str]]] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: counts of the base kinds, digests and ``spans``
    (kind:start:end by kind as in ``LABELS`` without "outside", then start; code points, end exclusive).

    A null text is empty and has no spans.  Repeated rows give repeated rows, an empty table none; other columns
    are not read.  The field only adds spans, and only where no base span lies.
    """
    field = Field.train(table or labelled_table())
    shared = docs.sparkSession.sparkContext.broadcast(field)
    order = {k: i for i, k in enumerate((*KINDS, "secret"))}

    def run(batches):
        for b in batches:
            counts, sha, spans = [[], [], [], []], [], []
            for base, added in find(b.column(1), shared.value):
                for c, s in zip(counts, base):
                    c.append(len(s))
                own = [(k, *s) for k, ss in zip(KINDS, base) for s in ss]
                sha.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in own).encode()).hexdigest())
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in sorted(own + added, key=lambda x: (order[x[0]], x[1], x[2]))))
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                                  names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets, and ``n_chars`` to match.

    Overlapping spans are replaced once, under the kind of the first.  A null text stays null.  Keeps all rows,
    columns and their order.
    """
    field = Field.train(labelled_table())
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            out = []
            texts = b.column(at).to_pylist()
            for text, (base, added) in zip(texts, find(b.column(at), shared.value)):
                spans = sorted([(s, e, k) for k, ss in zip(KINDS, base) for s, e in ss] + [(s, e, k) for k, s, e in added])
                if spans and text:
                    parts, last = [], 0
                    for s, e, k in spans:
                        if s >= last:
                            parts += [text[last:s], f"[{k.upper()}]"]
                        last = max(last, e)
                    text = "".join([*parts, text[last:]])
                out.append(text)
            columns = list(b.columns)
            columns[at] = pa.array(out, b.schema.field(at).type)
            yield pa.record_batch(columns, names=b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
