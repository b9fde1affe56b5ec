"""Personal data: exact base patterns, and a character-level BiLSTM-CRF that adds what they miss.

The network (two LSTMs over character classes, linear emissions, CRF
transitions over B/I tags of each kind) is trained here, in numpy, from labelled
spans: seeded synthetic sentences, and a bounded sample of documents labelled by
the base patterns.  A span holds a digit or an at sign, so only surroundings of
such characters are cut into windows; the windows overlap, their emissions are
blended by distance from the window's edge, and one Viterbi pass over the whole
covered stretch reconciles them.  A decoded span is added if it passes its
kind's check (digit counts, Luhn, number ranges) and touches no base span.

The base patterns are found leftmost and without overlap per kind, by scans that
stay linear on texts of any length.

Defined results: null and empty texts have no spans; offsets are code points,
end exclusive; repeated rows get equal results; an empty table gives an empty
result; columns of the input are kept unless named as an added one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._io import position, spread
from quillspark.llm._vec import buffers, text_sums

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_IS_TRIGGER = np.zeros(256, np.int64)
_IS_TRIGGER[48:58] = _IS_TRIGGER[64] = 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_ip(s: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in s.split(".")))


def is_card(s: str) -> bool:
    d = digits_of(s)
    return 12 <= len(d) <= 19 and luhn(d)


def is_phone(s: str) -> bool:
    return 9 <= len(digits_of(s)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[Span]:
    """The base patterns' matches that pass their checks, by start and kind."""
    out = [("email", a, b) for a, b in emails(text)]
    for kind, pattern, good in (("ip", _IP, is_ip), ("card", _CARD, is_card), ("phone", _PHONE, is_phone)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if good(m.group())]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Character classes: digits and letters are folded, what parts fields stays apart.
_MARKS = "@.-+() \n_%/:\"=#,;<>[]'|*$&!?"
PAD, DIGIT, LOW, UPPER, WIDE, OTHER, FIRST_MARK = range(7)
CLASSES = FIRST_MARK + len(_MARKS)


def classes(text: str) -> np.ndarray:
    out = np.empty(len(text), np.int64)
    for i, c in enumerate(text):
        out[i] = DIGIT if "0" <= c <= "9" else LOW if "a" <= c <= "z" else UPPER if "A" <= c <= "Z" else WIDE if c > "\x7f" else FIRST_MARK + _MARKS.index(c) if c in _MARKS else OTHER
    return out


TAGS = 1 + 2 * len(KINDS)


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a:b] = k + 1
        out[a] = k
    return out


def spans_of(tags: np.ndarray) -> list[Span]:
    out: list[Span] = []
    start = kind = None
    for i, t in enumerate([*tags.tolist(), 0]):
        if start is not None and (t == 0 or t % 2 == 1 or (t - 1) // 2 != kind):
            out.append((KINDS[kind], start, i))
            start = None
        if t % 2 == 1:
            start, kind = i, (t - 1) // 2
    return out


@dataclass(frozen=True)
class PiiParams:
    """window and stride in characters; max_docs bounds the sample of documents that training reads, max_doc_chars what it reads of one (from all over it)."""

    window: int = 64
    stride: int = 32
    margin: int = 24
    embedding: int = 10
    hidden: int = 16
    rounds: int = 260
    batch: int = 64
    rate: float = 0.02
    synthetic: int = 3000
    max_docs: int = 300
    max_doc_chars: int = 20_000
    seed: int = 5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstmCrf:
    """The network; weights are plain arrays, so it can be sent to workers as it is."""

    def __init__(self, params: PiiParams):
        rng = np.random.default_rng(params.seed)
        e, h = params.embedding, params.hidden
        normal = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"emb": normal(CLASSES, e, scale=0.3), "out": normal(2 * h, TAGS, scale=0.2), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p[f"x{d}"], self.p[f"h{d}"] = normal(e, 4 * h, scale=e**-0.5), normal(h, 4 * h, scale=h**-0.5)
            self.p[f"c{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.hidden = h
        # I tags follow only tags of their kind.
        self.allowed = np.ones((TAGS, TAGS), bool)
        for k in range(len(KINDS)):
            self.allowed[:, 2 + 2 * k] = False
            self.allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
        self.begin = np.array([t == 0 or t % 2 == 1 for t in range(TAGS)])

    def transitions(self) -> np.ndarray:
        return np.where(self.allowed, self.p["trans"], -1e4).astype(np.float32)

    def _lstm(self, x: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        h_size = self.hidden
        z = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h = c = np.zeros((len(x), h_size), np.float32)
        out = np.empty((len(x), x.shape[1], h_size), np.float32)
        w = self.p[f"h{d}"]
        for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
            a = z[:, t] + h @ w
            s = _sigmoid(a[:, : 3 * h_size])
            i, f, o, g = s[:, :h_size], s[:, h_size : 2 * h_size], s[:, 2 * h_size :], np.tanh(a[:, 3 * h_size :])
            before, c_before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if tape is not None:
                tape.append((t, i, f, o, g, tc, c_before, before))
        return out

    def emissions(self, x: np.ndarray, tapes: dict | None = None) -> np.ndarray:
        e = self.p["emb"][x]
        both = [self._lstm(e, d, tapes.setdefault(d, []) if tapes is not None else None) for d in "fb"]
        h = np.concatenate(both, axis=2)
        if tapes is not None:
            tapes["e"], tapes["h"] = e, h
        return h @ self.p["out"] + self.p["bias"]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences, and its gradient."""
        tapes: dict = {}
        s = self.emissions(x, tapes)
        n, length, _ = s.shape
        a = self.transitions()
        log_sum = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0] + np.where(self.begin, 0, -1e4)
        for t in range(1, length):
            alpha[:, t] = log_sum(alpha[:, t - 1, :, None] + a, 1) + s[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = log_sum(a + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = log_sum(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + a + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        rows, cols = np.arange(n)[:, None], np.arange(length)[None]
        gold = s[rows, cols, y].sum(1) + a[y[:, :-1], y[:, 1:]].sum(1)
        ds = marginal
        ds[rows, cols, y] -= 1
        ds /= n * length
        dt = pair.sum((0, 1))
        np.add.at(dt, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1.0)
        grad = {"trans": np.where(self.allowed, dt, 0) / (n * length), "out": np.einsum("blh,blt->ht", tapes["h"], ds), "bias": ds.sum((0, 1))}
        dh_all = ds @ self.p["out"].T
        de = np.zeros_like(tapes["e"])
        for k, d in enumerate("fb"):
            size = self.hidden
            dh_out = dh_all[:, :, k * size : (k + 1) * size]
            w, wx = self.p[f"h{d}"], self.p[f"x{d}"]
            gw, da_all = np.zeros_like(w), np.empty((n, length, 4 * size), np.float32)
            dh = dc = np.zeros((n, size), np.float32)
            for t, i, f, o, g, tc, c_before, before in reversed(tapes[d]):
                dh = dh + dh_out[:, t]
                dc = dc + dh * o * (1 - tc * tc)
                da = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                da_all[:, t] = da
                gw += before.T @ da
                dh, dc = da @ w.T, dc * f
            grad[f"h{d}"], grad[f"c{d}"] = gw, da_all.sum((0, 1))
            grad[f"x{d}"] = np.einsum("ble,blk->ek", tapes["e"], da_all)
            de += da_all @ wx.T
        grad["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grad["emb"], x, de)
        return float((z - gold).mean() / length), grad

    def viterbi(self, s: np.ndarray) -> np.ndarray:
        """The best tags of one stretch of emissions (length, tags)."""
        a = self.transitions()
        v = s[0] + np.where(self.begin, 0, -1e4)
        back = np.zeros(s.shape, np.int8)
        for t in range(1, len(s)):
            m = v[:, None] + a
            back[t] = m.argmax(0)
            v = m.max(0) + s[t]
        out = np.empty(len(s), np.int64)
        out[-1] = v.argmax()
        for t in range(len(s) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def synthetic(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Labelled sentences: each kind in its usual and in irregular spellings, among words, numbers, versions, dates, prices and hex strings."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    letters = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k).tolist())
    word = lambda: letters("abcdefghilmnorstuéäñ", int(rng.integers(2, 9)))
    num = lambda k: letters("0123456789", k)

    def card() -> str:
        body = pick("4", "5", "3") + num(14)
        body += next(str(c) for c in range(10) if luhn(body + str(c)))
        sep = pick("", "", " ", "-", ".")
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def make(kind: str) -> str:
        if kind == "email":
            at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), ("(@)", "."))
            return f"{word()}{pick('.', '_', '')}{num(2)}{at}{word()}{dot}{pick('com', 'org', 'net', 'example.com')}"
        if kind == "ip":
            return ".".join(str(int(rng.integers(0, 256))) for _ in range(4))
        if kind == "card":
            return card()
        return pick(f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(1)}/{num(3)}/{num(3)}/{num(4)}")

    def noise() -> str:
        return pick(word(), word(), word(), num(int(rng.integers(1, 6))), f"{num(1)}.{num(1)}", f"v{num(1)}.{num(1)}.{num(2)}", f"20{num(2)}-{num(2)}-{num(2)}", f"${num(3)}.{num(2)}", '"' + letters("0123456789abcdef", 40) + '"', f"#{num(7)}", f"@{word()}", word() + ",", word() + ".")

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(6, 14))):
            if rng.random() < 0.16:
                kind = pick(*KINDS)
                s = make(kind)
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += noise()
            text += pick(" ", " ", " ", " ", ", ", "\n", "*** ", "!! ")
        out.append((text, spans))
    return out


def windows_of(text: str, params: PiiParams) -> list[tuple[int, int, list[int]]]:
    """(start, end, window starts) of each stretch around digits and at signs; windows overlap and cover it."""
    runs: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - params.margin), min(len(text), m.end() + params.margin)
        if runs and a <= runs[-1][1]:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    return [(a, b, list(range(a, max(a + 1, b - (params.window - params.stride)), params.stride))) for a, b in runs]


def train(labelled: list[tuple[str, list[Span]]], params: PiiParams = PiiParams()) -> BiLstmCrf:
    """Fit by Adam on windows around digits and at signs of the labelled texts."""
    net = BiLstmCrf(params)
    xs, ys = [], []
    for text, spans in labelled:
        c, y = classes(text), tags_of(len(text), spans)
        for _, _, starts in windows_of(text, params):
            for a in starts:
                x, t = np.zeros(params.window, np.int64), np.zeros(params.window, np.int64)
                part, tags = c[a : a + params.window], y[a : a + params.window].copy()
                # A span that begins before the window starts anew at its edge.
                if len(tags) and tags[0] and tags[0] % 2 == 0:
                    tags[0] -= 1
                x[: len(part)], t[: len(tags)] = part, tags
                xs.append(x)
                ys.append(t)
    if not xs:
        return net
    x, y = np.array(xs), np.array(ys)
    rng = np.random.default_rng(params.seed + 1)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, params.rounds + 1):
        rows = rng.integers(0, len(x), params.batch)
        _, grad = net.loss(x[rows], y[rows])
        rate = params.rate * min(1.0, 2.0 * (1 - step / (params.rounds + 1)))
        for k, g in grad.items():
            g = np.clip(g, -1, 1).astype(np.float32)
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def _valid(kind: str, s: str) -> bool:
    d = digits_of(s)
    if kind == "email":
        return "@" in s and "." in s.split("@", 1)[1] and any(c.isalnum() for c in s.split("@", 1)[0])
    if kind == "ip":
        return bool(_IP.fullmatch(s)) and is_ip(s)
    if kind == "card":
        return is_card(s) and s[0].isdigit() and s[-1].isdigit() and not re.search("[A-Za-z]", s)
    return is_phone(s) and len(d) < len(s) and s[-1].isdigit() and not re.search("[A-Za-z\n]", s) and bool(re.search(r"[()/ -]", s))


def model_spans(texts: list[str], net: BiLstmCrf, params: PiiParams) -> list[list[Span]]:
    """The network's spans of each text; windows of all texts go through the network 512 at a time, and a stretch is decoded once its last one is through."""
    weight = np.minimum(np.arange(1, params.window + 1), np.arange(params.window, 0, -1)).astype(np.float32)[:, None]
    out: list[list[Span]] = [[] for _ in texts]
    waiting: list[tuple[int, int, int, int, bool]] = []
    xs = np.zeros((512, params.window), np.int8)
    sums: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def through() -> None:
        s = net.emissions(xs[: len(waiting)].astype(np.int64)) if waiting else ()
        for (k, a, b, w, last), e in zip(waiting, s):
            total, mass = sums.setdefault((k, a), (np.zeros((b - a, TAGS), np.float32), np.zeros((b - a, 1), np.float32)))
            n = min(params.window, b - w)
            total[w - a : w - a + n] += e[:n] * weight[:n]
            mass[w - a : w - a + n] += weight[:n]
            if last:
                del sums[k, a]
                for kind, i, j in spans_of(net.viterbi(total / np.maximum(mass, 1e-9))):
                    if _valid(kind, texts[k][a + i : a + j]):
                        out[k].append((kind, a + i, a + j))
        waiting.clear()

    for k, text in enumerate(texts):
        for a, b, starts in windows_of(text, params):
            for w in starts:
                part = classes(text[w : min(b, w + params.window)])
                x = xs[len(waiting)]
                x[:] = 0
                x[: len(part)] = part
                waiting.append((k, a, b, w, w == starts[-1]))
                if len(waiting) == len(xs):
                    through()
    through()
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def sample(docs: DataFrame, params: PiiParams = PiiParams()) -> list[str]:
    """At most max_docs texts with a digit or an at sign, those with the smallest hash of doc_id and length; of longer texts max_doc_chars, from all over them.

    Hashes are chosen first, so that no other texts are sorted or reach the driver.
    """
    some = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("doc_id", F.length("text")).alias("h"), "text")
    few = some.select("h").distinct().orderBy("h").limit(params.max_docs)
    picked = some.join(F.broadcast(few), "h", "left_semi").groupBy("h").agg(F.min(spread(F.col("text"), params.max_doc_chars)).alias("text"))
    return [r["text"] for r in sorted(picked.collect(), key=lambda r: r["h"])]


def fit(docs: DataFrame, params: PiiParams = PiiParams()) -> BiLstmCrf:
    labelled = synthetic(params.synthetic, params.seed) + [(t, base_spans(t)) for t in sample(docs, params)]
    return train(labelled, params)


ADDED = ("n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans")


def find(docs: DataFrame, net: BiLstmCrf, params: PiiParams = PiiParams()) -> DataFrame:
    """docs with the base counts, `base_spans` and `spans` (kind:start:end, comma-joined); one narrow pass."""
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_spans", T.StringType()), T.StructField("spans", T.StringType())])
    at = position(keep, "text")
    # A few thousand weights, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            data, offsets = buffers(batch.column(at))
            marked = np.flatnonzero(text_sums(_IS_TRIGGER[data], offsets))
            counts = np.zeros((len(KINDS), n), np.int64)
            base, every = [""] * n, [""] * n
            raw = data.tobytes() if len(marked) else b""
            for lo in range(0, len(marked), 64):
                rows = marked[lo : lo + 64].tolist()
                texts = [raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in rows]
                for i, text, added in zip(rows, texts, model_spans(texts, shared.value, params)):
                    own = base_spans(text)
                    for k, _, _ in own:
                        counts[KINDS.index(k), i] += 1
                    base[i] = joined(own)
                    taken = np.zeros(len(text) + 1, bool) if added else None
                    for _, a, b in own if added else []:
                        taken[a:b] = True
                    every[i] = joined(own + [s for s in added if not taken[s[1] : s[2]].any()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in counts], pa.array(base), pa.array(every)], names=[*keep, *ADDED])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def masked(text: str, spans: str) -> str:
    """text with every span of a `spans` string replaced by its kind in brackets."""
    out, done = [], 0
    for s in filter(None, spans.split(",")):
        kind, a, b = s.split(":")
        if int(a) >= done:
            out += [text[done : int(a)], f"[{kind}]"]
        done = max(done, int(b))
    return "".join([*out, text[done:]])


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
