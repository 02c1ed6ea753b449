"""Personal data: four patterns, and a character-level BiLSTM-CRF beside them.

The patterns' spans always stand. The tagger reads characters in both
directions, is trained in numpy from spans set into the documents' own prose,
and adds what the patterns do not know, such as phone numbers without a country
code, numbers with other marks between their parts and addresses with blanks.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, ship

KINDS = ("email", "ip", "card", "phone")
#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
# Runs of digits cannot be left and entered again, so these need no backtracking.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    """Whether a match of the kind's pattern is one."""
    if kind == "ip":
        return all(len(p) < 20 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in text.split(".")))
    if kind == "card":
        return 13 <= len(d := _digits(text)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(text)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: what may stand before it, back to the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and then by place."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    digits = _DIGIT.search(text) is not None
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        if digits and (kind != "phone" or "+" in text):
            found += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return found


def listed(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# ---- the tagger ----

#: Characters in a window, from one window's start to the next one's, and windows decoded at once.
WINDOW, STRIDE, BATCH = 128, 64, 256
EMBED, HIDDEN = 10, 14
#: Codes: 0 fill, ASCII characters by themselves, then letters beyond and the rest.
CODES = 130


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, points, np.where(points < 0x2000, 128, 129)).astype(np.int16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Embeddings, one LSTM in each direction, a linear layer and a CRF over its scores."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)

        def some(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)

        self.p = {"E": some(CODES, EMBED) * 3, "W": some(2, EMBED, 4 * HIDDEN), "U": some(2, HIDDEN, 4 * HIDDEN), "b": np.zeros((2, 1, 4 * HIDDEN), np.float32), "O": some(2 * HIDDEN, TAGS), "c": np.zeros(TAGS, np.float32), "A": np.zeros((TAGS, TAGS), np.float32)}
        self.p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1
        # A tag I may only follow B or I of its kind.
        self.bar = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.bar[[i for i in range(TAGS) if i not in (inside, inside - 1)], inside] = -1e4

    def _lstm(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(windows, time) -> (windows, time, 2 * HIDDEN); the second direction runs over reversed windows."""
        n, t = x.shape
        both = np.stack([x, x[:, ::-1]])
        into = np.matmul(self.p["E"][both].reshape(2, n * t, EMBED), self.p["W"]).reshape(2, n, t, 4 * HIDDEN) + self.p["b"][:, :, None]
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        out = np.empty((2, n, t, HIDDEN), np.float32)
        for i in range(t):
            z = into[:, :, i] + np.matmul(h, self.p["U"])
            gate = _sigmoid(z[..., : 3 * HIDDEN])
            new = np.tanh(z[..., 3 * HIDDEN :])
            before = c, h
            c = gate[..., HIDDEN : 2 * HIDDEN] * c + gate[..., :HIDDEN] * new
            squashed = np.tanh(c)
            h = gate[..., 2 * HIDDEN :] * squashed
            out[:, :, i] = h
            if keep is not None:
                keep.append((gate, new, squashed, *before))
        return np.concatenate([out[0], out[1][:, ::-1]], axis=2)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._lstm(x) @ self.p["O"] + self.p["c"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best path of tags and, by place, how far its tag's score is above O's."""
        s = self.scores(x)
        n, t, _ = s.shape
        move = self.p["A"] + self.bar
        best, back = s[:, 0] + np.where(np.arange(TAGS) % 2 == 0, np.where(np.arange(TAGS) > 0, -1e4, 0), 0), np.empty((n, t, TAGS), np.int8)
        for i in range(1, t):
            ways = best[:, :, None] + move
            back[:, i] = ways.argmax(axis=1)
            best = ways.max(axis=1) + s[:, i]
        path = np.empty((n, t), np.int8)
        path[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for i in range(t - 1, 0, -1):
            path[:, i - 1] = back[rows, i, path[:, i]]
        return path, np.take_along_axis(s, path[:, :, None].astype(np.int64), 2)[:, :, 0] - s[:, :, 0]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags ``y`` and its gradients."""
        n, t = x.shape
        kept: list = []
        h = self._lstm(x, kept)
        s = h @ self.p["O"] + self.p["c"]
        move = self.p["A"] + self.bar
        ahead, behind = np.empty_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0]
        for i in range(1, t):
            ahead[:, i] = _logsumexp(ahead[:, i - 1][:, :, None] + move, 1) + s[:, i]
        for i in range(t - 2, -1, -1):
            behind[:, i] = _logsumexp(move + (s[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        total = _logsumexp(ahead[:, -1], 1)
        ds = np.exp(ahead + behind - total[:, None, None])
        pairs = np.exp(ahead[:, :-1, :, None] + move + (s[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
        one = np.eye(TAGS, dtype=np.float32)[y]
        gold = (s * one).sum(axis=(1, 2)) + move[y[:, :-1], y[:, 1:]].sum(axis=1)
        loss = float((total - gold).mean())
        ds = (ds - one) / n
        np.subtract.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        g = {"A": pairs / n, "O": h.reshape(-1, 2 * HIDDEN).T @ ds.reshape(-1, TAGS), "c": ds.sum(axis=(0, 1))}
        dh = ds @ self.p["O"].T
        dh = np.stack([dh[..., :HIDDEN], dh[:, ::-1, HIDDEN:]])
        both = np.stack([x, x[:, ::-1]])
        dz_all = np.empty((2, n, t, 4 * HIDDEN), np.float32)
        gU = np.zeros_like(self.p["U"])
        dh_next = dc = np.zeros((2, n, HIDDEN), np.float32)
        turned = self.p["U"].transpose(0, 2, 1)
        for i in range(t - 1, -1, -1):
            gate, new, squashed, c0, h0 = kept[i]
            into, forget, out = gate[..., :HIDDEN], gate[..., HIDDEN : 2 * HIDDEN], gate[..., 2 * HIDDEN :]
            d = dh[:, :, i] + dh_next
            dc = dc + d * out * (1 - squashed**2)
            dz = np.concatenate([dc * new * into * (1 - into), dc * c0 * forget * (1 - forget), d * squashed * out * (1 - out), dc * into * (1 - new**2)], axis=2)
            dz_all[:, :, i] = dz
            gU += np.matmul(h0.transpose(0, 2, 1), dz)
            dh_next, dc = np.matmul(dz, turned), dc * forget
        flat = dz_all.reshape(2, n * t, 4 * HIDDEN)
        e = self.p["E"][both].reshape(2, n * t, EMBED)
        g |= {"U": gU, "W": np.matmul(e.transpose(0, 2, 1), flat), "b": flat.sum(axis=1, keepdims=True), "E": np.zeros_like(self.p["E"])}
        np.add.at(g["E"], both.reshape(-1), np.matmul(flat, self.p["W"].transpose(0, 2, 1)).reshape(-1, EMBED))
        return loss, g

    def train(self, examples: Sequence[tuple[str, Sequence[Span]]], steps: int, size: int = 48, rate: float = 0.015, seed: int = 2) -> Tagger:
        """Adam over batches of windows cut from the examples."""
        xs, ys = [], []
        for text, spans in examples:
            x, y = codes(text), np.zeros(len(text), np.int64)
            for kind, a, b in spans:
                y[a:b] = 2 + 2 * KINDS.index(kind)
                y[a] -= 1
            for lo in range(0, max(1, len(x)), WINDOW):
                if lo and 2 <= y[lo : lo + 1].sum() and y[lo] % 2 == 0:
                    continue  # would begin inside a span
                xs.append(np.pad(x[lo : lo + WINDOW], (0, WINDOW - len(x[lo : lo + WINDOW]))))
                ys.append(np.pad(y[lo : lo + WINDOW], (0, WINDOW - len(y[lo : lo + WINDOW]))))
        x, y, rng = np.array(xs), np.array(ys), np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), size)
            _, g = self.gradients(x[pick], y[pick])
            long = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
            lr = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, a in g.items():
                a = a * min(1, 5 / (long + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def labelled_texts(n: int = 900, seed: int = 5, prose: Sequence[str] = ()) -> list[tuple[str, list[Span]]]:
    """Texts of up to a window with spans of each kind, and numbers that are none.

    What stands between them are words of ``prose``, cut at random, or made-up
    ones where there is no prose.
    """
    r = random.Random(seed)
    bits = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "é", "ü", "ñ", "ç"]

    def digits(k):
        return "".join(r.choice("0123456789") for _ in range(k))

    def word():
        if prose and r.random() < 0.85:
            some = r.choice(prose).split(" ")
            at = r.randrange(len(some))
            return " ".join(some[at : at + r.randint(1, 6)]) or "a"
        w = "".join(r.choice(bits) for _ in range(r.randint(1, 4)))
        return r.choice([w, w, w, w.capitalize(), w.upper(), w + r.choice([".", ",", "!!", "###", "$$$", "&&&", "%%%", "***", " |"])])

    def name():
        return "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 9)))

    def email():
        local = name() + r.choice(["", "", "." + name(), "_" + digits(2), "." + digits(2), "+" + name()])
        host = name() + r.choice(["", digits(1)]) + r.choice(["", ".example"]) + "." + r.choice(["com", "org", "net", "de", "io"])
        return local + r.choice(["@", "@", "@", " @ ", "@ ", "[@]"]) + host

    def ip():
        return r.choice([".", ".", ".", " . ", "[.]"]).join(str(r.randint(0, 255)) for _ in range(4))

    def card():
        body = r.choice("3456") + digits(r.choice([14, 14, 14, 13]))
        full = body + next(d for d in "0123456789" if luhn(body + d))
        cut = r.choice(["", "", "-", " ", ".", "/", " - "])
        return cut.join(full[i : i + 4] for i in range(0, len(full), 4))

    def phone():
        return r.choice([f"+{r.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"+{r.randint(1, 99)}-{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(11)}", f"({digits(3)}) {digits(3)} {digits(4)}", f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"])

    def other():
        return r.choice([digits(r.randint(1, 8)), digits(r.randint(9, 18)), f"{digits(2)}:{digits(2)}:{digits(2)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}.{digits(2)}", f"{digits(3)},{digits(3)}.{digits(2)}", "".join(r.choice("0123456789abcdef") for _ in range(r.choice([16, 32, 40]))), f"@{name()}", f"token = {digits(5)}{name()}{digits(4)}", f"v{digits(1)}.{digits(2)}", f"{digits(4)} - {digits(4)}"])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    made = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW - 8:
            kind = r.choice([None, None, None, None, "other", "other", *KINDS])
            piece = word() if kind is None else other() if kind == "other" else makers[kind]()
            if len(text) + len(piece) > WINDOW:
                break
            if kind in makers:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + r.choice([" ", " ", " ", "\n", ". ", "###"])
        text = text[:WINDOW]
        made.append((text, spans))
    return made


#: Snippets of documents that the tagger is trained on, their characters, and its steps.
SNIPPETS, SNIPPET, STEPS = 800, 160, 320


@functools.lru_cache(4)
def trained(steps: int = STEPS, seed: int = 1, prose: tuple[str, ...] = ()) -> Tagger:
    """The tagger that ``labelled_texts`` trains: the same whenever it is."""
    return Tagger(seed).train(labelled_texts(1200, prose=prose), steps)


def fit(docs: DataFrame, fold: tuple[int, int] = (5, 0)) -> Tagger:
    """A tagger trained on spans set into prose of ``docs``, in whatever languages they are.

    The prose is SNIPPETS snippets from anywhere in the documents with the
    smallest hashes of their ids, outside the fold; those that the patterns find
    something in are left out.
    """
    long = F.greatest(F.length("text") - SNIPPET, F.lit(1))
    at = (F.pmod(F.xxhash64("doc_id", F.lit(1)), long.cast("long")) + 1).cast("int")
    rows = docs.where(F.col("text").isNotNull() & (remainder("doc_id", fold[0]) != fold[1])).select(F.xxhash64("doc_id").alias("h"), F.substring(F.col("text"), at, F.lit(SNIPPET)).alias("snippet"))
    # A cut by the hash's value, from the number of rows, leaves about twice as many as are taken.
    few = rows.where(F.col("h") / F.lit(2.0**64) + 0.5 <= (2 * SNIPPETS + 200) / max(1, docs.count()))
    found = sorted({r["snippet"] for r in few.orderBy("h", "snippet").limit(SNIPPETS).collect()})
    return trained(prose=tuple(t for t in found if t.strip() and not _ANCHOR.search(t)))


def _allowed(kind: str, text: str) -> bool:
    """What the tagger may add: an email holds an @ between other characters, a number the digits of its kind."""
    if kind == "email":
        return re.search(r"\S\s?@\s?\S", text) is not None
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return valid(kind, text)


def windows_of(text: str) -> list[int]:
    """Starts of the windows to be decoded.

    Windows begin at every multiple of STRIDE. A span of any kind holds a digit
    or an @, so windows without either cannot hold one and need no decoding.
    """
    starts: set[int] = set()
    last = max(0, (max(0, len(text) - WINDOW) + STRIDE - 1) // STRIDE)
    m = _ANCHOR.search(text)
    while m:
        k = m.start() // STRIDE
        starts.update(j * STRIDE for j in range(max(0, k - WINDOW // STRIDE + 1), k + 1) if j <= last)
        m = _ANCHOR.search(text, max((k + 1) * STRIDE, m.end()))
    return sorted(starts)


def reconcile(text: str, parts: Sequence[tuple[str, int, int, float, bool]], base: Sequence[Span]) -> list[Span]:
    """The windows' spans (kind, start, end, score, cut) as one set without overlaps.

    Spans of a kind that touch and that a window's edge has cut are joined. Of
    what then overlaps, the set with the highest sum of scores stays, found by
    dynamic programming over the whole text. Spans that meet a pattern's span,
    or that are no address or number, are left out.
    """
    joined: list[list] = []
    for kind in KINDS:
        run: list | None = None
        for _, a, b, score, cut in sorted(p for p in parts if p[0] == kind):
            if run and a <= run[2] and (cut or run[4]):
                run[2], run[3], run[4] = max(run[2], b), max(run[3], score), cut
            else:
                run = [kind, a, b, score, cut]
                joined.append(run)
    taken = sorted((a, b) for _, a, b in base)
    sure: dict[Span, float] = {}
    for kind, a, b, score, _ in joined:
        while a < b and text[a].isspace():
            a += 1
        while a < b and text[b - 1].isspace():
            b -= 1
        if not any(x < b and a < y for x, y in taken) and _allowed(kind, text[a:b]):
            sure[kind, a, b] = max(score, sure.get((kind, a, b), 0.0))
    rows = sorted(sure, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in rows]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for i, s in enumerate(rows):
        fits = int(np.searchsorted(ends[:i], s[1], "right"))
        with_it = best[fits][0] + max(sure[s], 1e-6)
        best.append((with_it, fits, True) if with_it > best[i][0] else (best[i][0], i, False))
    found, i = [], len(rows)
    while i:
        _, before, take = best[i]
        if take:
            found.append(rows[i - 1])
        i = before
    return found


def _tagged(texts: Sequence[str], model: Tagger) -> list[list[tuple[str, int, int, float, bool]]]:
    """The spans of all windows of the texts; windows of many texts share a batch."""
    where = [(i, lo) for i, t in enumerate(texts) for lo in windows_of(t)]
    found: list[list] = [[] for _ in texts]
    known: dict[int, np.ndarray] = {}
    for at in range(0, len(where), BATCH):
        some = where[at : at + BATCH]
        known = {i: known.get(i) if i in known else codes(texts[i]) for i in {i for i, _ in some}}
        x = np.zeros((len(some), WINDOW), np.int16)
        for row, (i, lo) in enumerate(some):
            piece = known[i][lo : lo + WINDOW]
            x[row, : len(piece)] = piece
        path, above = model.decode(x)
        for row in np.flatnonzero((path > 0).any(axis=1)):
            i, lo = some[row]
            long = min(WINDOW, len(texts[i]) - lo)
            tags, t = path[row, :long], 0
            while t < long:
                if tags[t] == 0:
                    t += 1
                    continue
                kind, end = (tags[t] - 1) // 2, t + 1
                while end < long and tags[end] == 2 + 2 * kind:
                    end += 1
                cut = (t == 0 and lo > 0) or (end == WINDOW and lo + end < len(texts[i]))
                found[i].append((KINDS[kind], lo + t, lo + end, float(above[row, t:end].sum()), cut))
                t = end
    return found


def spans_of(texts: Sequence[str], model: Tagger | None = None) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans and those that the tagger adds."""
    base = [base_spans(t) for t in texts]
    return [(b, reconcile(t, p, b)) for t, p, b in zip(texts, _tagged(texts, model or trained()), base, strict=True)]


def _rows(weights: dict[str, np.ndarray], with_text: bool):
    def rows(batches):
        model = Tagger()
        model.p = weights
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                both = spans_of(texts, model)
                counts = {f"n_{k}": pa.array([sum(s[0] == k for s in b) for b, _ in both], pa.int64()) for k in KINDS}
                sums = [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in both]
                out = {"doc_id": some.column(0), **counts, "base_sha256": sums, "spans": [listed([*b, *more]) for b, more in both], "n_added": pa.array([len(more) for _, more in both], pa.int64())}
                if with_text:
                    out["text"] = [_masked(t, [*b, *more]) for t, (b, more) in zip(texts, both, strict=True)]
                yield pa.record_batch(out)

    return rows


def _masked(text: str, spans: Sequence[Span]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if b > at:
            out += [text[at:a], f"<{kind}>"] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Tagger | None = None, masked: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added; with ``masked`` also the text, spans replaced.

    The counts and the hash are of the patterns' spans, ``spans`` lists these and
    the tagger's. Places count code points, ends are exclusive.

    Cases: null texts are empty ones and have no spans; doc_ids may be null or
    repeat; an empty table gives an empty result; no other column is read. A
    text of any length is one row's work, in windows.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    shape = f"doc_id {dict(docs.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return rows.mapInArrow(_rows((model or fit(docs)).p, masked), shape + (", text string" if masked else ""))
