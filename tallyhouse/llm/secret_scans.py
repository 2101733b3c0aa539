"""Secrets: patterns give candidates, a character convolutional network scores each one with the text around it.

The network is small and in numpy: letters are embedded, a convolution looks at every character of the candidate and its
context, the largest and mean responses inside and the largest outside decide. It is trained on labelled findings; scores
are calibrated on others, and each kind's threshold keeps the recall asked for on those.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, projected

#: Labelled findings the network is trained on, and those that calibrate it: the bounds of the sample.
TRAINING, CALIBRATION = 3000, 2000
SEED = 11
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Recall that a kind's threshold keeps on the findings for calibration.
RECALL = 0.98
#: Characters of context before and after a candidate.
BEFORE, AFTER = 24, 12
EMBEDDING, WIDTH, FILTERS = 8, 5, 24
#: Characters that the convolution looks at in one row; longer candidates take several rows.
SPAN = 48
#: Candidates scored together.
TOGETHER = 256

#: Patterns of base spans, in the order of their kinds, with the least length of the match or its group.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    # All runs of these letters, of which shorter ones would be dropped.
    "hex": (re.compile("[0-9a-f]{24,}"), 0, 24),
}
#: Patterns of further candidates: the group is the span. What the network does not take is dropped.
FURTHER = {
    "keyed": (re.compile(r"""(?:pwd|passphrase|credential|private_?key|client_?id|auth|bearer|signature)["']?\x20*[:=\x20]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.I | re.A), 1),
    "login": (re.compile(r"://[^\s:/@]+:([^\s/@]{4,})@"), 1),
    "mixed": (re.compile("[A-Za-z0-9+/_=-]{16,}"), 0),
}
#: A run of letters and digits holds both.
_MIXED = re.compile("[A-Za-z][^A-Za-z0-9]*[0-9]|[0-9][^A-Za-z0-9]*[A-Za-z]")
#: One of these is in every match, in any case.
WORDS = {
    "assign": ("password", "passwd", "secret", "token", "api"),
    "access": ("akia",),
    "keyed": ("pwd", "passphrase", "credential", "private", "client", "auth", "bearer", "signature"),
    "login": ("://",),
}
KINDS = [*BASE, *FURTHER]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base patterns, by start and then kind."""
    found, lowered = [], text.lower()
    for kind, (pattern, group, least) in BASE.items():
        for m in pattern.finditer(text) if _may_hold(kind, lowered) else ():
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _may_hold(kind: str, lowered: str) -> bool:
    """False only if a kind's pattern cannot match: none of its words is in the lower-case text."""
    return any(map(lowered.__contains__, WORDS[kind])) if kind in WORDS else True


def further_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates of the further patterns that share no character with a base span or an earlier candidate."""
    found, lowered = [], text.lower()
    for kind, (pattern, group) in FURTHER.items():
        if _may_hold(kind, lowered):
            found += [(*m.span(group), kind) for m in pattern.finditer(text)]
    found = [s for s in found if s[2] != "mixed" or _MIXED.search(text, *s[:2])]
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    free, at, reached = [], 0, 0
    ends = sorted((s, e) for s, e, _ in base)
    for start, end, kind in found:
        while at < len(ends) and ends[at][0] < end:
            reached = max(reached, ends[at][1])
            at += 1
        if start >= reached:
            free.append((start, end, kind))
            reached = end
    return free


@dataclass
class Network:
    """Weights, calibration ``(scale, shift)`` of the logit, and the threshold of each kind."""

    letters: np.ndarray  # one row for each of 128 characters; 0 is the padding, 1 any other
    filters: np.ndarray  # (WIDTH * (EMBEDDING + 1), FILTERS)
    bias: np.ndarray
    out: np.ndarray  # largest inside, mean inside, largest outside
    shift: float
    calibration: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] | None = None

    def scores(self, candidates: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated probabilities of ``(text, start, end)``."""
        parts = [self._features(*_rows(candidates[i : i + TOGETHER]))[0] for i in range(0, len(candidates), TOGETHER)]
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * (np.concatenate(parts) @ self.out + self.shift) + b, -50, 50)))

    def _features(self, codes: np.ndarray, inside: np.ndarray, known: np.ndarray, first: np.ndarray):
        """Pooled responses of each candidate; ``first`` is its first row of ``codes``."""
        layer = np.concatenate((self.letters[codes], inside[:, :, None]), axis=2)
        size = WIDTH * (EMBEDDING + 1)
        patches = np.lib.stride_tricks.sliding_window_view(layer, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(-1, SPAN, size)
        response = np.maximum(patches @ self.filters + self.bias, 0)
        within = inside[:, WIDTH // 2 : WIDTH // 2 + SPAN, None]
        around = known[:, WIDTH // 2 : WIDTH // 2 + SPAN, None] - within
        own, other = response * within, response * around
        count = np.add.reduceat(within.sum(axis=1), first)
        features = np.concatenate(
            (
                np.maximum.reduceat(own.max(axis=1), first),
                np.add.reduceat(own.sum(axis=1), first) / np.maximum(count, 1),
                np.maximum.reduceat(other.max(axis=1), first),
            ),
            axis=1,
        )
        return features, (patches, response, own, other, within, count)


_CODES = bytes([1, *range(2, 128), 1][i] if i < 128 else 1 for i in range(256))


def _rows(candidates: list[tuple[str, int, int]]) -> tuple[np.ndarray, ...]:
    """Codes, whether inside, whether known, in rows of ``SPAN`` characters with half a filter's width on each side."""
    half, rows, first = WIDTH // 2, [], []
    for text, start, end in candidates:
        low = max(0, start - BEFORE)
        shown = text[low : end + AFTER].encode("latin-1", "replace").translate(_CODES)
        first.append(len(rows))
        for at in range(0, len(shown), SPAN):
            rows.append((shown[max(0, at - half) : at + SPAN + half], half if not at else 0, start - low - at + half, end - low - at + half))
    codes = np.zeros((len(rows), SPAN + 2 * half), dtype=np.int64)
    inside = np.zeros(codes.shape)
    for i, (shown, left, start, end) in enumerate(rows):
        codes[i, left : left + len(shown)] = np.frombuffer(shown, dtype=np.uint8)
        inside[i, max(0, start) : max(0, end)] = 1
    return codes, inside, (codes > 0).astype(float), np.array(first)


def trained(training: list[tuple[str, int, int, str, bool]], calibration: list[tuple[str, int, int, str, bool]], recall: float = RECALL) -> Network:
    """A network from labelled findings ``(text, start, end, kind, secret)``."""
    r = np.random.default_rng(SEED)
    size = WIDTH * (EMBEDDING + 1)
    net = Network(
        r.normal(0, 0.5, (128, EMBEDDING)), r.normal(0, size**-0.5, (size, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.1, 3 * FILTERS), 0.0
    )
    weights = [net.letters, net.filters, net.bias, net.out, np.zeros(1)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = r.permutation(len(training))
        for at in range(0, len(order), BATCH):
            some = [training[i] for i in order[at : at + BATCH]]
            gradients = _gradients(net, _rows([f[:3] for f in some]), np.array([f[4] for f in some], dtype=float))
            step += 1
            for w, g, (m, v) in zip(weights, gradients, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            net.shift = float(weights[4][0])
    truth = np.array([f[4] for f in calibration], dtype=float)
    p = np.clip(net.scores([f[:3] for f in calibration]), 1e-9, 1 - 1e-9)
    net.calibration = _calibrated(np.log(p / (1 - p)), truth)
    score = net.scores([f[:3] for f in calibration])
    net.thresholds = {}
    for kind in KINDS:
        own = np.sort(score[[f[3] == kind and f[4] for f in calibration]])
        # The largest threshold at which no more than 1 - recall of the secrets fall below; never under an even chance's tenth.
        net.thresholds[kind] = float(max(0.05, own[int((1 - recall) * len(own))])) if len(own) else 0.5
    return net


def _gradients(net: Network, rows: tuple[np.ndarray, ...], truth: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy, for letters, filters, bias, out and shift."""
    codes, _, _, first = rows
    features, (patches, response, own, other, within, count) = net._features(*rows)
    error = (1 / (1 + np.exp(-np.clip(features @ net.out + net.shift, -50, 50))) - truth) / len(truth)
    back = error[:, None] * net.out
    largest, mean, outside = back[:, :FILTERS], back[:, FILTERS : 2 * FILTERS], back[:, 2 * FILTERS :]
    number = np.repeat(np.arange(len(first)), np.diff([*first, len(codes)]))
    delta = within * (mean / np.maximum(count, 1))[number][:, None, :]
    f = np.arange(FILTERS)
    for values, pooled, gradient in ((own, features[:, :FILTERS], largest), (other, features[:, 2 * FILTERS :], outside)):
        at = values.argmax(axis=1)
        row = np.arange(len(codes))[:, None]
        top = values[row, at, f] == pooled[number]
        delta[row, at, f] += np.where(top, gradient[number], 0)
    delta *= response > 0
    flat = delta.reshape(-1, FILTERS)
    size = WIDTH * (EMBEDDING + 1)
    into = (flat @ net.filters.T).reshape(len(codes), SPAN, WIDTH, EMBEDDING + 1)[..., :EMBEDDING]
    letters = np.zeros_like(net.letters)
    for k in range(WIDTH):
        np.add.at(letters, codes[:, k : k + SPAN], into[:, :, k])
    letters[0] = 0
    return [letters, patches.reshape(-1, size).T @ flat, flat.sum(axis=0), features.T @ error, np.array([error.sum()])]


def _calibrated(logit: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits of greatest likelihood, by Newton steps; a small ridge keeps them finite."""
    x = np.stack((logit, np.ones_like(logit)), axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        ridge = np.diag([1e-2, 1e-2])
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - truth) + ridge @ (w - [1, 0]))
    return float(w[0]), float(w[1])


_ANY = string.ascii_letters + string.digits
_SYLLABLES = "an be cher con de dor en er est fi ga hel in ka le ment mo nor on pra que re sa ti tion u ver wa xi zu".split()


def labelled_finding(r: random.Random) -> tuple[str, int, int, str, bool]:
    """One labelled candidate in invented text: kinds of keys, logins and tokens, and look-alikes of each."""

    def word() -> str:
        return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))

    def prose(most: int) -> str:
        return " ".join(word() for _ in range(r.randint(0, most)))

    def drawn(letters: str, least: int, most: int) -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(least, most)))

    def key() -> str:
        form = r.randrange(7)
        if form == 0:
            return drawn("0123456789abcdef", 24, 64)
        if form == 1:
            return r.choice(["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-", "pk_", "AIza"]) + drawn(_ANY, 20, 36)
        if form == 2:
            return drawn(_ANY + "+/", 20, 60) + r.choice(["", "=", "=="])
        if form == 3:
            return "eyJ" + drawn(_ANY + "_-", 20, 80)
        if form == 4:
            return "AKIA" + drawn(string.ascii_uppercase + string.digits, 16, 16)
        return drawn(_ANY, 16, 40)

    def look_alike() -> str:
        form = r.randrange(8)
        if form == 0:
            return "-".join([word(), word(), str(r.randint(1, 2030)), word(), word()])
        if form == 1:
            return f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-{r.randint(10, 59)}Z"
        if form == 2:
            return "/".join([word(), word(), word() + str(r.randint(0, 99)), word()])
        if form == 3:
            return "_".join([word(), word(), word(), word(), "v" + str(r.randint(1, 99))])
        if form == 4:
            return "".join(word().title() for _ in range(4)) + str(r.randint(1, 99))
        if form == 5:
            return r.choice("abcdex") + str(r.randint(0, 9)) * r.randint(16, 24)
        if form == 6:
            return "=" * r.randint(8, 20) + word() + str(r.randint(1, 9)) + "=" * 8
        return "".join(word() for _ in range(5)) + str(r.randint(0, 2030))

    secret = r.random() < 0.5
    kind = r.choice(KINDS)
    if kind in ("assign", "keyed"):
        name = r.choice(["password", "passwd", "secret", "token", "api_key", "apikey"] if kind == "assign" else ["pwd", "passphrase", "credential", "private_key", "auth", "bearer", "signature"])
        filler = r.choice(["your_token_here", "changeme_please", "example-value", "xxxxxxxxxxxx", "undefined", "None.None", "process.env.KEY", "os.environ.get", "authorization", word() + word(), word() + "." + word()])
        value = r.choice([key(), key(), drawn(_ANY, 10, 16)]) if secret else r.choice([filler, filler, look_alike()])
        value = value if len(value) >= 8 else value + "-value-1"
        lead = r.choice([name, name.upper(), f'"{name}"']) + r.choice([" = ", "=", ": ", ":"]) + r.choice(['"', "'", ""])
        shown, inside = lead + value, (0 if kind == "assign" else len(lead), len(lead) + len(value))
    elif kind == "login":
        value = drawn(_ANY + "!$%", 8, 20) if secret else r.choice(["password", "pass", "<password>", "user", "xxxx", "${PASSWORD}", "secret", "8080"])
        lead = f"{r.choice(['https', 'postgres', 'ftp', 'redis'])}://{word()}:"
        shown, inside = f"{lead}{value}@{word()}.example", (len(lead), len(lead) + len(value))
    elif kind == "access":
        value = "AKIA" + drawn(string.ascii_uppercase + string.digits, 16, 16) if secret else "AKIA" + r.choice(["X" * 16, "0" * 16, "EXAMPLE" * 3])
        shown, inside = value, (0, len(value))
    elif kind == "hex":
        value = drawn("0123456789abcdef", 24, 64) if secret else r.choice([drawn("0123456789abcdef", 40, 64), str(r.randint(0, 9)) * 32, "deadbeef" * 4])
        lead = r.choice(["key ", "session ", "", "secret is ", f"{word()} "]) if secret else r.choice(["commit ", "sha256:", "md5 ", "checksum ", "etag ", "digest "])
        shown, inside = lead + value, (len(lead), len(lead) + len(value))
    else:
        value = key() if secret else look_alike()
        value = value if len(value) >= 16 else value + "-" + word() + word() + "1" * 12
        shown, inside = value, (0, len(value))
    before, after = prose(6), prose(4)
    before += " " if before else ""
    at = len(before)
    text = before + shown + r.choice(['"', "'", "", ".", "\n"]) + " " + after
    return text, at + inside[0], at + inside[1], kind, secret


@lru_cache(1)
def network() -> Network:
    r = random.Random(SEED)
    findings = [labelled_finding(r) for _ in range(TRAINING + CALIBRATION)]
    return trained(findings[:TRAINING], findings[TRAINING:])


def findings(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    net: Callable[[], Network] = network,
) -> DataFrame:
    """``doc_id, spans`` of every row, also those without any; a span is ``kind, start, end, score, secret``.

    All candidates of the whole text are scored: base spans, which always stay, and further ones, which stay if they reach
    their kind's threshold; ``secret`` tells that of base spans too. Spans are ordered by start, then by kind as listed in
    ``KINDS``; positions are code points, the end is exclusive. A null text is empty; null and repeated ids are rows of
    their own; other columns are ignored; an empty table gives no rows. A candidate may be of any length.
    """
    kind = dict(documents.dtypes)[id_column]
    given = projected(documents, doc_id=id_column, text=text_column)
    model = net()

    def rows(documents: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []
        waiting = 0
        for doc_id, text in documents:
            base = base_spans(text or "")
            spans = [*base, *further_spans(text or "", base)]
            # Only what the network looks at is kept until a batch is full.
            shown = [(text[max(0, s - BEFORE) : e + AFTER], min(s, BEFORE), min(s, BEFORE) + e - s) for s, e, _ in spans]
            held.append((doc_id, spans, shown))
            waiting += len(shown)
            if waiting >= TOGETHER or len(held) >= 4096:
                yield from scored(held)
                held, waiting = [], 0
        yield from scored(held)

    def scored(held: list[tuple]) -> Iterator[tuple]:
        shown = [c for _, _, own in held for c in own]
        score = iter(model.scores(shown).tolist() if shown else [])
        for doc_id, spans, _ in held:
            found = []
            for (start, end, kind), p in zip(spans, [next(score) for _ in spans]):
                secret = p >= model.thresholds[kind]
                if kind in BASE or secret:
                    found.append({"kind": kind, "start": start, "end": end, "score": round(p, 6), "secret": secret})
            yield doc_id, sorted(found, key=lambda x: (x["start"], KINDS.index(x["kind"])))

    return map_rows(
        given, rows, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, score: double, secret: boolean>>", rows=1024
    )


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, n_secret`` of :func:`findings`.

    ``n_added`` counts spans beyond the base, ``n_secret`` the spans that the network takes for secrets.
    """
    def count(condition):
        return F.size(F.filter("spans", condition)).cast("bigint")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def is_base(span):
        return span.kind.isin(*BASE)

    def of_kind(kind):
        return lambda span: span.kind == kind

    counts = [count(of_kind(k)).alias(f"n_{k}") for k in BASE]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.filter("spans", is_base)), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        count(lambda s: ~is_base(s)).alias("n_added"),
        count(lambda s: s.secret).alias("n_secret"),
    )
