"""Secret scan by a linear-chain conditional random field on top of fixed patterns.

Tokens are tagged begin, inside or outside from their shape, the kinds of their neighbours and features of the file.
The field is trained here, on windows of a bounded sample of texts, of any length, into which secrets and harmless
look-alikes are planted: with key words and in formats that the fixed patterns do not know as well as in those that
they do. What the fixed patterns find in a window is a secret too; all else of it is outside. Decoding is Viterbi's. A token whose score for outside leads by more than all transitions
could make up is outside on every best path, so only the stretches between such tokens are decoded: the tags are those
of decoding the whole text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A run of 16 or more is found from its first character, as a run of any length is.
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")
#: Words that announce a secret, alone or as the last part of a compound name.
KEYWORD = re.compile(r"(?i:(?:[\w.-]*[_.-])?(?:password|passwd|passphrase|pwd|secret|tokens?|api_?key|apikey|credentials?|auth|authorization|bearer|(?:private|access|client|signing|session)_?key))\Z", re.A)

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
TOKEN = re.compile(r"[\w+/.-]+|[^\w\s+/.-]+")
_SHAPES = (
    "word", "title", "upper", "digits", "hex", "lower_digits", "upper_digits", "mixed_digits", "mixed", "keyword", "access", "quote", "assign", "other", "pieces", "random", "at", "edge",
)
_KIND = {name: i for i, name in enumerate(_SHAPES)}
_LENGTHS = (4, 8, 12, 16, 20, 32, 40)
_N_CLASSES = len(_SHAPES) * (len(_LENGTHS) + 1)
_OFFSETS = (-3, -2, -1, 1)
_EDGE = _KIND["edge"]
_DIGITS = [_KIND[k] for k in ("digits", "hex", "lower_digits", "upper_digits", "mixed_digits", "random")]
_PIECE = re.compile(r"[A-Za-z0-9]+")
_TURN = re.compile(r"[a-z]+|[A-Z]+|[0-9]+")
_N_FILES = 6

#: Texts of the training sample at most, windows of each, and characters of a window.
SAMPLE_TEXTS, WINDOWS, WINDOW_CHARS = 80, 3, 1200


def _random(piece: str) -> bool:
    """Whether a run of letters and digits changes between cases and digits as often as chance does, names do not."""
    turns = len(_TURN.findall(piece)) - 1
    return len(piece) >= 12 and turns >= 5 and turns >= 0.35 * len(piece)


def shape(token: str) -> int:
    """Class of a token: its kind of characters and its length."""
    digits = sum(c.isdigit() for c in token)
    if KEYWORD.match(token):
        kind = "keyword"
    elif token.startswith("AKIA") and token.isalnum():
        kind = "access"
    elif token[0] in "\"'" and len(token) == 1:
        kind = "quote"
    elif not (set("=:").isdisjoint(token)):
        kind = "assign"
    elif not any(c.isalnum() for c in token):
        kind = "at" if token == "@" else "other"
    elif len(token) >= 12 and any(map(_random, _PIECE.findall(token))):
        kind = "random"
    elif any(c in "/.+-" for c in token.rstrip(".")) or not token.isascii() and digits:
        lower, upper = token.lower() == token, token.upper() == token
        kind = "mixed_digits" if digits and not set("+/").isdisjoint(token) and not lower and not upper and "." not in token else "pieces"
    else:
        lower, upper = token.lower() == token, token.upper() == token
        if not digits:
            kind = "word" if lower else "upper" if upper else "title" if token[0].isupper() and token[1:].lower() == token[1:] else "mixed"
        elif token.isdigit():
            kind = "digits"
        elif lower:
            kind = "hex" if all(c in "0123456789abcdef" for c in token) else "lower_digits"
        else:
            kind = "upper_digits" if upper else "mixed_digits"
    size = sum(len(token) >= n for n in _LENGTHS)
    return _KIND[kind] * (len(_LENGTHS) + 1) + size


class _Shapes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = shape(token)
        if len(token) <= 64:
            self[token] = value
        return value


def file_class(classes: np.ndarray) -> int:
    """Of a whole text: how many of its tokens have digits, and whether a keyword stands in it."""
    if not len(classes):
        return 0
    kinds = classes // (len(_LENGTHS) + 1)
    counts = np.bincount(kinds, minlength=len(_SHAPES))
    share = counts[_DIGITS].sum() / len(kinds)
    return int(share > 0.02) + int(share > 0.2) + 3 * int(counts[_KIND["keyword"]] > 0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, sorted."""
    out = []
    lowered = text.lower()
    if any(k in lowered for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


@dataclass
class Field:
    """Weights by tag: own class, kind of neighbour at each offset, file class, and transitions [from, to]."""

    own: np.ndarray
    near: np.ndarray
    file: np.ndarray
    step: np.ndarray
    start: np.ndarray

    def scores(self, classes: np.ndarray, spots: np.ndarray, file: int) -> np.ndarray:
        """Emission scores of the tokens at ``spots``."""
        kinds = classes // (len(_LENGTHS) + 1)
        out = self.own[classes[spots]] + self.file[file]
        for k, offset in enumerate(_OFFSETS):
            at = spots + offset
            inside = (at >= 0) & (at < len(classes))
            out = out + self.near[k, np.where(inside, kinds[np.clip(at, 0, len(classes) - 1)], _EDGE)]
        return out

    def settle(self) -> None:
        """What decoding needs: the most that a tag other than outside can gain from transitions, and leads by feature."""
        gain = [0.0]
        for tag in (BEGIN, INSIDE):
            before = [self.step[p, tag] - self.step[p, OUTSIDE] for p in range(3)] + [self.start[tag] - self.start[OUTSIDE]]
            behind = [self.step[tag, q] - self.step[OUTSIDE, q] for q in range(3)] + [0.0]
            gain.append(max(before) + max(behind))
        self.slack = float(max(gain))
        lead = lambda w: w[..., OUTSIDE] - w[..., 1:].max(-1)
        self.lead_own, self.lead_near, self.lead_file = lead(self.own), lead(self.near), lead(self.file)

    def doubtful(self, classes: np.ndarray, file: int) -> np.ndarray:
        """Tokens that may be other than outside: the rest lead by more than ``slack``, summed feature by feature."""
        n = len(classes)
        kinds = np.full(n + 4, _EDGE)
        kinds[3 : n + 3] = classes // (len(_LENGTHS) + 1)
        lead = self.lead_own[classes] + self.lead_file[file]
        for k, offset in enumerate(_OFFSETS):
            lead += self.lead_near[k][kinds[3 + offset : 3 + offset + n]]
        return np.flatnonzero(lead <= self.slack)

    def tag(self, classes: np.ndarray) -> list[tuple[int, int]]:
        """(first, last) tokens of each secret; an inside without a begin before it begins one."""
        if not len(classes):
            return []
        file = file_class(classes)
        spots = self.doubtful(classes, file)
        if not len(spots):
            return []
        score = self.scores(classes, spots, file)
        out = []
        cuts = np.flatnonzero(np.diff(spots) > 1) + 1
        for run, own in zip(np.split(spots, cuts), np.split(score, cuts), strict=True):
            tags = self.viterbi(own, run[0] == 0, run[-1] == len(classes) - 1)
            k = 0
            while k < len(tags):
                if tags[k] == OUTSIDE:
                    k += 1
                    continue
                first = k
                k += 1
                while k < len(tags) and tags[k] == INSIDE:
                    k += 1
                out.append((int(run[first]), int(run[k - 1])))
        return out

    def viterbi(self, score: np.ndarray, at_start: bool, at_end: bool) -> list[int]:
        """Best tags of a stretch; a neighbour beyond it, if there is one, is outside."""
        best = score[0] + (self.start if at_start else self.step[OUTSIDE])
        back = []
        for row in score[1:]:
            ways = best[:, None] + self.step
            back.append(ways.argmax(0))
            best = ways.max(0) + row
        if not at_end:
            best = best + self.step[:, OUTSIDE]
        tags = [int(best.argmax())]
        for choice in reversed(back):
            tags.append(int(choice[tags[-1]]))
        return tags[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit(sequences: Sequence[tuple[np.ndarray, np.ndarray]], rounds: int = 45, rate: float = 0.5, ridge: float = 1e-3, width: int = 80) -> Field:
    """Maximum likelihood by adaptive gradient steps, over windows of ``width`` tokens of (classes, tags) sequences."""
    rows = []
    for classes, tags in sequences:
        file = file_class(classes)
        kinds = classes // (len(_LENGTHS) + 1)
        padded = np.concatenate([[_EDGE] * 3, kinds, [_EDGE]])
        near = np.stack([padded[3 + o : 3 + o + len(kinds)] for o in _OFFSETS], 1)
        for at in range(0, len(classes), width):
            rows.append((classes[at : at + width], near[at : at + width], file, tags[at : at + width]))
    n = len(rows)
    own, near, tag = np.zeros((n, width), int), np.full((n, width, len(_OFFSETS)), _EDGE), np.zeros((n, width), int)
    mask, file = np.zeros((n, width), bool), np.array([r[2] for r in rows], int)
    for i, (c, k, _, t) in enumerate(rows):
        own[i, : len(c)], near[i, : len(c)], tag[i, : len(c)], mask[i, : len(c)] = c, k, t, True
    w = Field(np.zeros((_N_CLASSES, 3)), np.zeros((len(_OFFSETS), len(_SHAPES), 3)), np.zeros((_N_FILES, 3)), np.zeros((3, 3)), np.zeros(3))
    names = ("own", "near", "file", "step", "start")
    power = {k: np.full_like(getattr(w, k), 1e-6) for k in names}
    hot = np.eye(3)
    flat_own, flat_near = own[mask], near[mask]
    flat_file = np.repeat(file, mask.sum(1))
    total = float(mask.sum())
    for _ in range(rounds):
        emit = w.own[own] + w.file[file][:, None] + sum(w.near[k, near[:, :, k]] for k in range(len(_OFFSETS)))
        forward, backward = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        forward[:, 0] = emit[:, 0] + w.start
        for t in range(1, width):
            forward[:, t] = np.where(mask[:, t, None], _log_sum(forward[:, t - 1, :, None] + w.step, 1) + emit[:, t], forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            backward[:, t] = np.where(mask[:, t + 1, None], _log_sum(w.step + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2), backward[:, t + 1])
        norm = _log_sum(forward[:, -1], 1)
        gap = hot[tag] - np.exp(forward + backward - norm[:, None, None])
        flat = gap[mask]
        both = mask[:, 1:]
        pairs = np.exp(forward[:, :-1, :, None] + w.step + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - norm[:, None, None, None])
        slope = {
            "own": np.stack([np.bincount(flat_own, flat[:, k], _N_CLASSES) for k in range(3)], 1),
            "near": np.stack([np.stack([np.bincount(flat_near[:, o], flat[:, k], len(_SHAPES)) for k in range(3)], 1) for o in range(len(_OFFSETS))]),
            "file": np.stack([np.bincount(flat_file, flat[:, k], _N_FILES) for k in range(3)], 1),
            "step": (hot[tag[:, :-1]][..., :, None] * hot[tag[:, 1:]][..., None, :] - pairs)[both].sum(0),
            "start": gap[:, 0].sum(0),
        }
        for k in names:
            g = slope[k] / total - ridge / 100 * getattr(w, k)
            power[k] += g * g
            setattr(w, k, getattr(w, k) + rate * g / np.sqrt(power[k]))
    w.settle()
    return w


def labelled(text: str, spans: Sequence[tuple[int, int]], known: _Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of a text's tokens, given its secrets."""
    found = list(TOKEN.finditer(text))
    tags = np.zeros(len(found), int)
    ends = sorted(spans)
    k, inside = 0, False
    for i, m in enumerate(found):
        while k < len(ends) and ends[k][1] <= m.start():
            k, inside = k + 1, False
        if k < len(ends) and m.start() < ends[k][1] and m.end() > ends[k][0]:
            tags[i] = INSIDE if inside else BEGIN
            inside = True
    return np.array([known[m[0]] for m in found], int), tags


LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _makers(pick, rng) -> tuple[tuple, tuple]:
    """Makers of secrets that need no announcement, and of those that are one only behind a key word."""
    between = lambda a, b: int(rng.integers(a, b))
    every = LOW + UP + DIGITS
    prefix = lambda: pick(LOW, between(2, 6)) + str(rng.choice(["_", "-"]))
    alone = (
        lambda: pick(every, between(20, 48)), lambda: prefix() + pick(every, between(20, 40)), lambda: prefix() + str(rng.choice(["live", "test", "prod"])) + "_" + pick(every, 24),
        lambda: prefix() + pick(DIGITS, 12) + "-" + pick(every, 24), lambda: ".".join(pick(every + "_-", between(20, 60)) for _ in range(3)), lambda: pick(every + "+/", between(32, 64)),
        lambda: pick("0123456789ABCDEF", between(32, 65)), lambda: "AKIA" + pick(UP + DIGITS, 16), lambda: pick("0123456789abcdef", between(32, 65)),
    )
    announced = (
        lambda: pick(every, between(8, 17)), lambda: pick(LOW + DIGITS, between(8, 24)), lambda: pick(UP + DIGITS, between(8, 24)), lambda: pick(LOW, 4) + pick(DIGITS, 4),
        lambda: pick("0123456789abcdef", between(12, 32)), lambda: pick(every, 4) + "-" + pick(every, 4) + "-" + pick(every, 4),
    )
    return alone, announced


def _harmless(pick, rng) -> tuple:
    between = lambda a, b: int(rng.integers(a, b))
    return (
        lambda: pick(DIGITS, between(1, 20)), lambda: f"{pick(LOW, 5)}.{pick(LOW, 6)}{pick(DIGITS, 2)}@{pick(LOW, 7)}.com", lambda: f"https://www.{pick(LOW, 8)}.com/{pick(LOW, 4)}/{pick(DIGITS, 5)}.html",
        lambda: f"+{pick(DIGITS, 2)} {pick(DIGITS, 3)}-{pick(DIGITS, 4)}", lambda: f"{pick(DIGITS, 4)}-{pick(DIGITS, 2)}-{pick(DIGITS, 2)}", lambda: pick(UP, between(2, 24)), lambda: pick(LOW, between(12, 40)),
        lambda: "".join(pick(LOW, between(3, 8)).title() for _ in range(between(2, 5))), lambda: "".join(pick(LOW, between(3, 8)).title() for _ in range(3)) + pick(DIGITS, 1), lambda: f"token = {pick(LOW, 5)}",
        lambda: f"version {pick(DIGITS, 1)}.{pick(DIGITS, 2)}", lambda: f"{pick(DIGITS, 3)}.{pick(DIGITS, 3)}.{pick(DIGITS, 1)}.{pick(DIGITS, 2)}", lambda: pick(UP, 2) + pick(DIGITS, 5), lambda: pick(LOW, 4) + pick(DIGITS, 2),
        lambda: f"section: {pick(LOW, 9)}", lambda: f"the secret {pick(LOW, 7)}", lambda: f"password {pick(LOW, 6)}", lambda: pick(LOW, 8) + "###", lambda: pick(LOW, 6) + "/" + pick(LOW, 9), lambda: pick(DIGITS, 16) + "$$$",
        lambda: f"{pick(LOW, 6)}_{pick(LOW, 7)}_{pick(LOW, 5)}", lambda: f"{pick(LOW, 6)}-{pick(LOW, 7)}-{pick(DIGITS, 4)}", lambda: f"auth: {pick(LOW, 8)}", lambda: f"{pick(LOW, 5)}: {pick(DIGITS, 6)}",
    )


#: Key words and frames of planted secrets; the first words and frames are those that the base patterns know.
KEYS = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "Password", "API_KEY", "SECRET", "pwd", "passphrase", "credential", "auth", "client_secret", "access_key", "private_key", "db_password", "AUTH_TOKEN", "signing-key",
)
FRAMES = (
    "{k} = \"{v}\"", "{k}: {v}", "{k}={v}", "'{k}': '{v}'", "use {v} as {k}", "{k} {v}", "export {K}={v}", "{k} is {v}", "Authorization: Bearer {v}", "{k} -> {v}", "the {k} ({v})", "{k}, {v},",
)


def planted(texts: Sequence[str], seed: int = 5, each: int = 5, makers=None) -> list[tuple[str, list[tuple[int, int]]]]:
    """``texts`` with about ``each`` secrets and twice as many look-alikes between their words, and the secrets' spans.

    Spans of the fixed patterns in what results are secrets too. The draw is fixed by the seed.
    """
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    alone, announced = (makers or _makers)(pick, rng)
    harmless = _harmless(pick, rng)
    out = []
    for text in texts:
        words = text.split(" ")
        chance = min(0.3, 3 * each / max(1, len(words)))
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0
        for word in words:
            for piece, value in [*([_piece(rng, alone, announced, harmless)] if rng.random() < chance else []), (word, None)]:
                if value is not None:
                    begin = at + piece.index(value)
                    spans.append((begin, begin + len(value)))
                parts.append(piece)
                at += len(piece) + 1
        made = " ".join(parts)
        out.append((made, sorted({*spans, *(_value(made, *s) for s in base_spans(made))})))
    return out


def _piece(rng, alone, announced, harmless) -> tuple[str, str | None]:
    """What is planted, and the secret in it: one of three is a secret, a quarter of those stands alone."""
    if rng.random() > 1 / 3:
        return harmless[rng.integers(len(harmless))](), None
    if rng.random() < 0.25:
        value = alone[rng.integers(len(alone))]()
        return value, value
    makers = (*alone, *announced)
    value, key = makers[rng.integers(len(makers))](), str(rng.choice(KEYS))
    return str(rng.choice(FRAMES)).format(k=key, K=key.upper(), v=value), value


def generated(n: int = 60, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines of invented words with planted secrets and look-alikes, where there is no text to plant them in."""
    rng = np.random.default_rng(seed + 1)
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    lines = [" ".join(pick(LOW, rng.integers(1, 12)) + str(rng.choice(["", "", "", ",", "."])) for _ in range(120)) for _ in range(n)]
    return planted(lines, seed)


def sample_windows(documents: DataFrame, texts: int = SAMPLE_TEXTS) -> list[str]:
    """Windows of the ``texts`` documents with the lowest hash of doc_id: bounded in number and in length, wherever they lie."""
    length = F.coalesce(F.length("text"), F.lit(0))
    start = lambda k: (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(length - WINDOW_CHARS, F.lit(1)).cast("long")) + 1).cast("int")
    windows = F.array(*[F.substring(F.col("text"), start(k), F.lit(WINDOW_CHARS)) for k in range(WINDOWS)])
    rows = documents.where(length > 0).select("doc_id", F.array_distinct(windows).alias("w")).orderBy(F.xxhash64("doc_id"), "doc_id", "w").limit(texts).collect()
    return [w for r in rows for w in r["w"]]


def train(documents: DataFrame, texts: int = SAMPLE_TEXTS) -> Field:
    """Fit on planted windows of a bounded sample of ``documents`` and on generated lines."""
    known = _Shapes()
    lines = generated() + planted(sample_windows(documents, texts), 9, 3)
    return fit([labelled(text, spans, known) for text, spans in lines if TOKEN.search(text)])


def _value(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """The secret itself in a base span: an assignment's keyword is not part of it."""
    return (ASSIGN.match(text, start).start(2), end) if kind == 0 else (start, end)


def scan(text: str, field: Field, known: _Shapes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans and of the field's spans that overlap none of them, sorted."""
    base = base_spans(text)
    tokens = TOKEN.findall(text)
    secrets = field.tag(np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens)))
    if not secrets:
        return base
    places = [m.span() for m in TOKEN.finditer(text)]
    added, covered = [], sorted((s, e) for s, _, e in base)
    k = 0
    for first, last in secrets:
        start, end = places[first][0], places[last][1]
        while k < len(covered) and covered[k][1] <= start and all(c[1] <= start for c in covered[k : k + 3]):
            k += 1
        if not any(s < end and e > start for s, e in covered[max(0, k - 3) : k + 64]):
            added.append((start, 3, end))
    return sorted(base + added)


def _joined(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


class SecretScanner:
    """Column functions of a trained field, which is a few thousand numbers and travels with the task."""

    def __init__(self, field: Field):
        self.field = field

    def report(self, text: Column) -> Column:
        field = self.field
        kind = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

        def run(texts: pa.Array) -> pa.Array:
            known, rows = _shapes(), []
            for scalar in texts:
                spans = scan(scalar.as_py() or "", field, known)
                base = [s for s in spans if s[1] < 3]
                rows.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))

        return F.arrow_udf(run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")(text)

    def redact(self, text: Column, mark: str = "[SECRET]") -> Column:
        """The text with each secret, or run of overlapping ones, replaced; null stays null."""
        field = self.field

        def run(texts: pa.Array) -> pa.Array:
            known, out = _shapes(), []
            for scalar in texts:
                value = scalar.as_py()
                spans = scan(value, field, known) if value else []
                out.append(_redacted(value, spans, mark) if spans else value)
            return pa.array(out, pa.string())

        return F.arrow_udf(run, "string")(text)


_KNOWN: list[_Shapes] = []


def _shapes() -> _Shapes:
    if not _KNOWN:
        _KNOWN.append(_Shapes())
    return _KNOWN[0]


def _redacted(text: str, spans: Sequence[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_report(documents: DataFrame) -> DataFrame:
    """doc_id, counts, base digest and all spans of every row. One pass, no shuffle; other columns are not read.

    A null text counts as empty and has no spans. Spans that start together are in the order of KINDS. Repeated rows
    give repeated rows, an empty table an empty one; a text of any length is read whole.
    """
    scanner = SecretScanner(train(documents))
    return documents.select("doc_id", scanner.report(F.col("text")).alias("r")).select("doc_id", "r.*")


def redacted(documents: DataFrame) -> DataFrame:
    """``documents`` with secrets replaced in ``text`` and ``n_chars`` counted anew, every other column as it is.

    A null text stays null, and so does its n_chars; texts without secrets stay as they are. Spans that overlap are
    one mark. Repeated rows stay repeated; an empty table gives an empty one.
    """
    scanner = SecretScanner(train(documents))
    return documents.withColumn("text", scanner.redact(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))
