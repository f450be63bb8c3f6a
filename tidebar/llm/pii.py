"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides."""
from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm import features as ft
from tidebar.llm.text import byte_column
from tidebar.sources.scratch import materialize

#: Kinds in their order within one start; the first four are found by pattern and check alone and always stay.
KINDS = ("email", "ip", "card", "phone", "secret", "account", "name")
BASE = 4
#: Probability from which an added span is kept.
KEEP = 0.5

# The patterns of the base kinds. Look-behinds only keep a run of digits from being tried from each of its digits.
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Patterns of candidates for the added kinds
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}")
_NAME = re.compile(r"(?<![^\W_])[A-Z][a-z]+ [A-Z][a-z]+(?![^\W_])")

# Gazetteers
ENDINGS = frozenset("com org net edu gov io co info biz de fr es it uk us ca eu nl ch at be pl ru cn jp in br au".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98")
KEY_HEADS = ("sk-", "sk_live_", "pk_live_", "ghp_", "gho_", "glpat-", "AKIA", "ASIA", "xoxb-", "xoxp-", "AIza", "eyJ")
GIVEN = frozenset(("James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
                   "Daniel Lisa Matthew Nancy Anthony Sandra Mark Ashley Donald Emily Steven Anna Paul Laura Andrew Emma Joshua Julia Kevin Maria Brian Peter Hans Klaus "
                   "Pierre Marie Jean Claire Luc Sophie Carlos Ana Juan Carmen Pedro Lucia Miguel Elena Jose Isabel Antonio Rosa Wolfgang Ursula Stefan Sabine").split())
CUES = {
    "email": ("mail", "contact", "reach", "write to"), "ip": ("ip", "host", "server", "addr", "login"), "card": ("card", "visa", "master", "payment", "credit"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"), "secret": ("token", "secret", "key", "password", "passwd", "credential", "bearer", "auth"),
    "account": ("account", "iban", "konto", "compte", "cuenta", "ssn", "passport", "card", "number", "no."), "name": ("name", "mr", "mrs", "ms", "dr", "herr", "frau", "dear", "by", "contact", "sr"),
}
_CUE_CHARS = 32
LABELERS = ("pattern", "check", "gazetteer", "context", "entropy", "border", "prose")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, looked for around each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``(kind, start, end)`` of the base kinds: those that pass their check, and those that fail."""
    good, failed = [], []
    if "@" in text:
        good.extend((0, a, b) for a, b in _emails(text))
    for m in _IP.finditer(text):
        fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
        (good if fits else failed).append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 9:
            continue
        d = _digits(m.group())
        (good if 14 <= len(d) <= 19 and luhn(d) else failed).append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (good if 10 <= len(_digits(m.group())) <= 15 else failed).append((3, *m.span()))
    return good, failed


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """``(kind, start, end, base)`` of all candidate spans, by start and kind. A digit run of its own that fails as a card
    is a candidate account; added candidates never lie on a base span."""
    good, failed = base_spans(text)
    found = [(k, a, b, True) for k, a, b in good]
    apart = lambda a, b: not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
    more = [(5, a, b) for k, a, b in failed if k == 2 and len(_digits(text[a:b])) >= 9 and apart(a, b)]
    for m in _TOKEN.finditer(text):
        s = m.group()
        if any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s):
            more.append((4, *m.span()))
    more.extend((6, *m.span()) for m in _NAME.finditer(text))
    taken = sorted((a, b) for _, a, b in good)
    for k, a, b in sorted(more, key=lambda c: (c[1], c[0])):
        if not any(x < b and a < y for x, y in taken):
            found.append((k, a, b, False))
    return sorted(found, key=lambda c: (c[1], c[0]))


def _entropy(span: str) -> float:
    n = len(span)
    return -sum(c / n * math.log2(c / n) for c in (span.count(x) for x in set(span)))


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """A vote of each labeler on a span: 1 for personal data, 0 against, -1 for none."""
    span, name = text[start:end], KINDS[kind]
    digits = _digits(span)
    before = text[max(0, start - _CUE_CHARS):start].lower()
    border = not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum())
    solid = span == digits
    if name == "email":
        pattern, check, gazetteer = re.fullmatch(r"[\w.+-]+@[\w-]+(\.[\w-]+)*\.[A-Za-z]{2,}", span) is not None, -1, span.rpartition(".")[2].lower() in ENDINGS
    elif name == "ip":
        octets = [int(p) for p in span.split(".")]
        pattern, check, gazetteer = all(str(o) == p for o, p in zip(octets, span.split("."))), 0 < octets[0] < 255, 0 if octets[0] in (0, 127) or octets == [0] * 4 else -1
    elif name == "card":
        pattern, check, gazetteer = solid or re.fullmatch(r"\d{4}([ -]\d{4}){2,3}([ -]\d{1,4})?", span) is not None, luhn(digits), digits[0] in "3456"
    elif name == "phone":
        pattern, check, gazetteer = re.fullmatch(r"\+\d{1,3}[ .-]?\(?\d+\)?([ .-]?\d+)+", span) is not None, 10 <= len(digits) <= 15, digits.startswith(CALLING)
    elif name == "secret":
        hexed = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span) is not None
        pattern, check = hexed or len(digits) >= 4, -1
        gazetteer = 1 if span.startswith(KEY_HEADS) or (hexed and len(span) in (32, 36, 40, 64)) else -1
    elif name == "account":
        pattern, check, gazetteer = solid and len(digits) <= 19, 0 if len(set(digits)) <= 2 else -1, 1 if solid and len(digits) in (9, 16) else -1
    else:
        first, last = span.split(" ")
        pattern, check, gazetteer = len(first) > 1 and len(last) > 2, -1, first in GIVEN
    context = 1 if any(c in before for c in CUES[name]) else 0 if name in ("account", "name") else -1
    entropy = _entropy(span)
    spread = 1 if entropy >= 3.2 else 0 if entropy < 1.8 else -1
    prose = 0 if not digits and "@" not in span and name != "name" else -1 if digits else 0 if name == "name" and context < 1 else -1
    return tuple(int(v) for v in (pattern, check, gazetteer, context, spread, border, prose))


def code(text: str, kind: int, start: int, end: int) -> int:
    """A span's kind, votes and shape in one number: what the corpus is counted by and the classifier sees."""
    span = text[start:end]
    out = kind
    for v in votes(text, kind, start, end):
        out = out * 3 + v + 1
    length = min(3, (end - start) // 12)
    share = min(3, 4 * sum(c.isdigit() for c in span) // len(span))
    upper = any(c.isupper() for c in span)
    quoted = start > 0 and text[start - 1] in "\"'=:(<[" or end < len(text) and text[end] in "\"')>]"
    return ((out * 4 + length) * 4 + share) * 4 + 2 * upper + quoted


def _open_code(c: int) -> tuple[int, list[int], list[int]]:
    """Kind, votes and shape of a code."""
    shape = [c // 16 % 4, c // 4 % 4, c // 2 % 2, c % 2]
    c //= 64
    found = []
    for _ in LABELERS:
        found.append(c % 3 - 1)
        c //= 3
    return c, found[::-1], shape


def estimate(kinds: np.ndarray, table: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Expectation-maximisation over vote patterns and their counts.

    Unknown: whether a pattern's spans are personal data, with a share for each kind, and for each
    labeler how often it votes for a true and against a false span where it votes at all. Starts from
    the majority of votes. Returns a probability for each pattern, and the reliabilities."""
    yes, no = table == 1, table == 0
    q = (yes.sum(1) + 1.0) / (yes.sum(1) + no.sum(1) + 2.0)
    share = hit = reject = None
    for _ in range(rounds):
        w1, w0 = (weight * q)[:, None], (weight * (1 - q))[:, None]
        hit = ((w1 * yes).sum(0) + 4) / ((w1 * (yes | no)).sum(0) + 5)
        reject = ((w0 * no).sum(0) + 4) / ((w0 * (yes | no)).sum(0) + 5)
        share = np.array([((weight * q)[kinds == k].sum() + 1) / (weight[kinds == k].sum() + 2) for k in range(len(KINDS))])
        z = np.log(share[kinds] / (1 - share[kinds])) + yes @ np.log(hit / (1 - reject)) + no @ np.log((1 - hit) / reject)
        q = ft.sigmoid(z)
    return q, {"share": share, "hit": hit, "reject": reject}


def _inputs(opened: list[tuple[int, list[int], list[int]]]) -> np.ndarray:
    """Indicators of kind, votes and shape."""
    rows = []
    for kind, vote, shape in opened:
        x = [1.0, *(float(kind == k) for k in range(len(KINDS)))]
        for v in vote:
            x += [float(v == 1), float(v == 0)]
        x += [float(shape[0] == k) for k in range(4)] + [float(shape[1] == k) for k in range(4)] + [float(shape[2]), float(shape[3])]
        rows.append(x)
    return np.array(rows).reshape(len(opened), -1)


def fit_spans(counts: dict[int, int]) -> dict[int, float]:
    """A probability for each code in the corpus: a logistic classifier on kind, votes and shape, trained on what
    expectation-maximisation makes of the votes, each code with the root of its number of spans."""
    if not counts:
        return {}
    codes = sorted(counts)
    opened = [_open_code(c) for c in codes]
    n = np.array([counts[c] for c in codes], float)
    q, _ = estimate(np.array([k for k, _, _ in opened]), np.array([v for _, v, _ in opened]), n)
    x, weight = _inputs(opened), np.sqrt(n)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's method
        p = ft.sigmoid(x @ w)
        grad = x.T @ (weight * (p - q)) + 0.1 * w
        hess = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    return dict(zip(codes, ft.sigmoid(x @ w).tolist()))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for data in byte_column(batch, "text"):
            text = data.decode("utf-8", "replace")
            found.append([{"kind": KINDS[k], "start": a, "end": b, "base": base, "code": code(text, k, a, b)} for k, a, b, base in candidates(text)])
        yield pa.record_batch([batch.column("id"), batch.column("text_key"), pa.array(found, pa.list_(_SPAN))], ["id", "text_key", "found"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_key, spans array<struct<kind, start, end, base, probability>>)``, a row for each row of ``docs``.

    Offsets are code points, the end is exclusive; spans are in the order of their starts, then of ``KINDS``.
    Spans of the base kinds that pass their check are always there (``base``). Added are secrets, account numbers and
    names whose probability reaches ``KEEP``. All candidates of the corpus are counted by kind, votes and shape
    (a few thousand codes at most, whatever the corpus); reliabilities and the classifier come from these counts.

    Null and empty texts have no spans; repeated rows come out repeated; other columns are ignored."""
    kind = docs.schema[id_col].dataType.simpleString()
    struct = "struct<kind:string,start:int,end:int,base:boolean,code:bigint>"
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    met = materialize(source.mapInArrow(_search, f"id {kind}, text_key bigint, found array<{struct}>"), "candidates")
    counts = {r.code: r.n for r in met.select(F.explode("found.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    probability = fit_spans(counts)
    kept = sorted(c for c, p in probability.items() if p >= KEEP)
    table = F.map_from_arrays(F.array(*[F.lit(c).cast("long") for c in kept]).cast("array<long>"), F.array(*[F.lit(probability[c]) for c in kept]).cast("array<double>"))
    stays = F.filter("found", lambda s: s["base"] | s["code"].isin(kept)) if kept else F.filter("found", lambda s: s["base"])
    spans = F.transform(stays, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"),
                                                  F.coalesce(F.element_at(table, s["code"]), F.lit(0.0)).alias("probability")))
    return met.select("id", "text_key", spans.alias("spans"))
