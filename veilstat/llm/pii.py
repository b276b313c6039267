"""Personal data: fixed base patterns, and spans that boosted trees add from overlapping candidates.

Base spans (email, ip, card, phone) come from fixed patterns, leftmost and non-overlapping per kind, with the
checks of validity; a match that fails is dropped. Each pattern runs in time linear in the text.

High-recall generators then propose spans that the base misses, which may overlap: telephone numbers without a plus
sign, cards and addresses with other separators or inside a longer run, mail addresses with `[at]`, `(dot)` or the bare
words. Boosted trees score each proposal by its format (digits, groups, separators, check digits, labels) and its
context (cue words before it, what stands next to it). No rule decides after them: a proposal that fails a check digit
is left out because the trees have learned to.

They learn from planted data: into TRAIN_WINDOWS windows of at most TRAIN_DOCS documents (smallest hash of the id) go
made-up data of every kind in many formats, and look-alikes (broken check digits, dates, book and part numbers,
amounts, prose with "at" and "dot"). A proposal that is a planted datum is positive; other proposals there are
negative. On a fifth of the documents, an isotonic fit for each kind calibrates the scores, and the kind gets the
lowest threshold whose precision is PRECISION. Accepted proposals that overlap no base span are added, best first, without overlaps.

Nulls and empty texts have no spans. Repeated rows stay; columns of the result's names in the input are replaced; an
empty table gives an empty result. Offsets are code points, ends exclusive. A very long text is held as one string;
every pass over it is linear, with tables of its candidates only.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstat.llm._boost import Boosted, fit_boosted, isotonic
from veilstat.llm._spark import one_row_an_id, shared, small_batches
from veilstat.sources.tables import table

KINDS = ["email", "ip", "card", "phone"]
TRAIN_DOCS, TRAIN_WINDOWS, WINDOW_CHARS = 2000, 6000, 300
PRECISION = 0.99
Span = tuple[int, int, int]  # start, kind, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

REGION = re.compile(r"[+(]?[0-9][0-9 ().,/\[\]-]*")
AT = re.compile(r" ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:at|AT) ")
HIDDEN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]++)++")
PROPOSALS = [
    (3, re.compile(r"(?<![0-9A-Za-z+])(?:(?:\+|00)?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z])(?:\+|00)[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])")),
    (3, re.compile(r"(?<![0-9A-Za-z+])0[0-9]{2,4}[ /-][0-9]{3,8}(?:[ -][0-9]{2,4})?(?![0-9A-Za-z])")),
    (2, re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ .,/-][0-9]{4}){2,3}[ .,/-][0-9]{1,7})(?![0-9A-Za-z])")),
    (1, re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?: ?\[\.\] ?| \. |\.)[0-9]{1,3}){3}(?![0-9A-Za-z])")),
]
# Cue words before a datum, and before numbers that are none, in English, German, French and Spanish.
CUES = re.compile(r"(?i)\b(?:tel|telefon|phone|call|mobile|fax|card|karte|carte|tarjeta|visa|credit|ip|host|server|mail|e-mail|correo|contact|kontakt|address|adresse|appelez|llame|write)\b")
OTHER_CUES = re.compile(r"(?i)\b(?:order|part|model|isbn|version|ref|invoice|since|date|no|nr|id|serial|section|chapter|page|total|sum|token|bestellung|rechnung|seite|commande|pedido)\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def octets(text: str) -> bool:
    """Every digit run is at most 255."""
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in re.findall(r"[0-9]+", text))


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, by start, then kind."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in IP.finditer(text):
        if octets(m[0]):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    at = text.find("+")
    while at >= 0:
        m = PHONE.match(text, at)
        if m and 10 <= sum(c.isdecimal() for c in m[0]) <= 15:
            out.append((at, 3, m.end()))
        at = text.find("+", m.end() if m else at + 1)
    out.sort()
    return out


def proposals(text: str) -> list[Span]:
    """High-recall spans of every kind; they may overlap."""
    out: set[Span] = set()
    for region in REGION.finditer(text):
        if region.end() - region.start() < 7 or sum(c.isdecimal() for c in region[0]) < 4:
            continue
        for kind, pattern in PROPOSALS:
            for m in pattern.finditer(text, region.start(), region.end() + 1):
                out.add((m.start(), kind, m.end()))
    last = 0
    for at in AT.finditer(text):
        m = HIDDEN_DOMAIN.match(text, at.end())
        start = at.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at.start():
            out.add((start, 0, m.end()))
        last = at.end()
    at, last = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if m and start < at:
            out.add((start, 0, m.end()))
        at, last = text.find("@", at + 1), at + 1
    return sorted(out)


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context features of a proposal."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    d = digits_of(s)
    groups = re.findall(r"[0-9]+", s)
    side = lambda c: [float(c.isalpha()), float(c.isdecimal()), float(c in "\"'=:/#")]
    mark = AT.search(s) if kind == 0 else None
    local, domain = (s[: mark.start()], s[mark.end() :]) if mark else (s, "")
    labels = re.findall(r"[A-Za-z0-9-]+", re.sub(r"[\[({ ](?:dot|DOT)[\])} ]", ".", domain))
    return [
        *[float(kind == k) for k in range(4)], float(len(s)), float(len(d)), len(d) / len(s), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(s.startswith("+")), float(s.startswith("0")), float("(" in s), float(s.count(" ")), float(s.count("-")), float(s.count(".")), float(s.count("/")), float(s.count(",")), float("[" in s),
        float(kind == 2 and bool(d) and luhn(d)), float(kind == 1 and octets(s)), float(len(set(d))), float(13 < len(d) < 20), float(9 < len(d) < 16),
        float(len(groups[0]) if groups else 0), float(groups[0].startswith("97") if groups else 0), float(len({len(g) for g in groups})),
        float(bool(mark) and mark[0].strip(" ")[0] in "[({<"), float(bool(re.search("[0-9._+-]", local))) if mark else 0.0, float(len(local)) if mark else 0.0, float(len(labels)), float(len(labels[-1]) if labels else 0), float(" dot " in domain.lower()),
        *side(before[-1:] or " "), *side(after[:1] or " "),
        float(bool(re.search(r"[0-9] ?$", before))), float(bool(re.match(r" ?[0-9]", after))), float(bool(CUES.search(before))), float(bool(OTHER_CUES.search(before))),
    ]


def card_digits(rng: random.Random, length: int, sound: bool) -> str:
    """Random digits that pass the check, or fail it."""
    d = str(rng.randint(3, 6)) + "".join(rng.choice("0123456789") for _ in range(length - 2))
    right = next(c for c in "0123456789" if luhn(d + c))
    return d + (right if sound else rng.choice("0123456789".replace(right, "")))


def datum(rng: random.Random) -> tuple[int, str]:
    """(kind, text) of a made-up datum in one of many formats."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    kind = rng.randrange(4)
    if kind == 0:
        local = rng.choice([w() + rng.choice("._-") + w(), w() + n(2), w(), w()[:1] + "." + w() + n(2)])
        at = rng.choice([" [at] ", "[at]", " (at) ", "(at)", " {at} ", " at ", " AT "])
        dot = rng.choice([" dot ", " DOT "]) if at.strip() in ("at", "AT") else rng.choice([".", " [dot] ", "[dot]", " (dot) ", " dot ", "[.]"])
        return 0, local + at + dot.join([w(), *([w()] if rng.random() < 0.3 else []), rng.choice(["com", "org", "net", "de", "fr", "es", "info"])])
    if kind == 1:
        return 1, rng.choice(["[.]", " [.] ", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        d = card_digits(rng, rng.choice([14, 15, 16, 16, 16, 16, 19]), True)
        return 2, rng.choice(".,/").join(d[i : i + 4] for i in range(0, len(d), 4))
    a, b, c = str(rng.randint(2, 9)) + n(2), n(3), n(4)
    return 3, rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a}/{b}{c}", f"0{a} {b}{c}", f"00{rng.choice(['49', '33', '34', '1'])} {a} {b}{c}", f"00{rng.randint(30, 59)}-{a}-{b}-{c}"])


def look_alike(rng: random.Random) -> str:
    """Text that generators may propose and that is no datum."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    d = card_digits(rng, rng.choice([14, 15, 16, 16, 16, 16, 19]), False)
    return rng.choice([
        lambda: d, lambda: rng.choice(".,/- ").join(d[i : i + 4] for i in range(0, len(d), 4)), lambda: f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(1900, 2030)} {n(2)}:{n(2)}", lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1, 999)},{n(3)},{n(3)}.{n(2)}",
        lambda: f"{rng.randint(1, 99)} {n(3)} {n(3)} {n(3)}", lambda: f"{n(5)}-{n(4)}", lambda: f"{rng.choice(['order', 'part', 'model', 'ref', 'no', 'serial'])} {n(3)}-{n(3)}-{n(4)}", lambda: f"{rng.choice(['order', 'id', 'invoice'])} {n(10)}",
        lambda: f"{rng.choice(['section', 'version'])} {rng.randint(1, 9)}[.]{rng.randint(1, 9)}[.]{rng.randint(300, 999)}[.]{rng.randint(1, 9)}", lambda: " . ".join(str(rng.randint(256, 999)) for _ in range(4)),
        lambda: f"{w()} at {w()}.{w()}", lambda: f"{w()} at {w()}. {w().title()} {w()}", lambda: f"{w()} (at) {w()}", lambda: f"{w()} at {w()} dot", lambda: f"{n(30)}", lambda: f"{n(4)}/{n(4)}/{n(2)}", lambda: f"0.{n(4)} {n(3)}",
    ])()


def planted(text: str, seed: int, windows: int = 3) -> Iterator[tuple[str, set[Span]]]:
    """Windows of a text with made-up data and look-alikes between its words, and the spans of the data, its own base spans too."""
    rng = random.Random(seed)
    for _ in range(windows):
        at = rng.randrange(max(1, len(text) - WINDOW_CHARS))
        window = text[at : at + WINDOW_CHARS]
        own, free = base_spans(window), Taken()
        for start, _, end in own:
            free.add(start, end)
        gaps = [i + 1 for i, c in enumerate(window[:-1]) if c == " " and free.free(i, i + 1)]
        out, last, spans = "", 0, set()
        for gap in [g for g in gaps if rng.random() < 6 / (len(gaps) + 1)] + [len(window)]:
            spans |= {(s - last + len(out), k, e - last + len(out)) for s, k, e in own if last <= s < gap}
            out, last = out + window[last:gap], gap
            if gap == len(window):
                break
            if rng.random() < 0.6:
                kind, made = datum(rng)
                out += rng.choice(["", "", "", "tel ", "call ", "mail ", "Kontakt: ", "carte ", "host ", "write to "])
                if kind == 2 and rng.random() < 0.4:  # side by side, where the base takes both for one number
                    one, made = (card_digits(rng, 16, True) for _ in range(2))
                    spans.add((len(out), 2, len(out) + 16))
                    out += one + rng.choice([" ", "-"])
                spans.add((len(out), kind, len(out) + len(made)))
            else:
                made = look_alike(rng)
            out += made + rng.choice([" ", ", ", ". ", "\n"])
        yield out, spans


def training_rows(text: str, windows: int) -> Iterator[tuple[list[float], int]]:
    """Labelled features of the proposals in planted windows that no base span overlaps."""
    for window, spans in planted(text, zlib.crc32(text.encode()), windows):
        taken = Taken()
        for start, _, end in base_spans(window):
            taken.add(start, end)
        for s in proposals(window):
            if taken.free(s[0], s[2]):
                yield describe(window, *s), int(s in spans)


@dataclass
class Model:
    """Trees, the isotonic fit of each kind, and its threshold."""

    trees: Boosted | None
    fits: list[tuple[np.ndarray, np.ndarray]]
    thresholds: list[float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(x)
        out = 1 / (1 + np.exp(-margin))
        for k, (xs, ys) in enumerate(self.fits):
            own = x[:, k] == 1
            if len(xs):
                out[own] = np.interp(margin[own], xs, ys)
        return out


def in_order(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(held, x, y) of rows (held, x, y), by these; numbers stay in arrays, whatever the number of rows."""
    held, y = (rows.column(c).to_numpy() for c in ("held", "y"))
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1) if len(y) else np.zeros((0, 0))
    order = np.lexsort((y, *x.T[::-1], held))
    return held[order].astype(bool), x[order], y[order]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Model from planted data; ids first, then only the chosen texts, one an id."""
    small_batches(docs.sparkSession)
    ids = docs.filter("doc_id is not null and text is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)

    windows = -(-TRAIN_WINDOWS // max(1, ids.count()))

    def rows(batches):
        for batch in batches:
            found = [(zlib.crc32(t.as_py().encode()) % 5 == 0, *r) for t in batch.column(0) for r in training_rows(t.as_py(), windows)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in found], pa.bool_()), pa.array([x for _, x, _ in found], pa.list_(pa.float64())), pa.array([y for *_, y in found], pa.int32())], names=["held", "x", "y"])

    chosen = one_row_an_id(docs.filter("text is not null"), ids, ["text"]).select("text")
    held, x, y = in_order(chosen.mapInArrow(rows, "held boolean, x array<double>, y int").toArrow())
    none = [(np.array([]), np.array([]))] * 4
    if len(set(y[~held].tolist())) < 2:
        return Model(None, none, [2.0] * 4)
    trees = fit_boosted(x[~held], y[~held], trees=80, depth=4)
    model = Model(trees, list(none), [2.0] * 4)
    for k in range(4):
        own = held & (x[:, k] == 1)
        if len(set(y[own].tolist())) < 2:
            continue  # nothing to set a threshold by
        model.fits[k] = isotonic(trees.margin(x[own]), y[own])
        p = model.probability(x[own])
        for t in np.unique(p[p >= 0.5]):
            if y[own][p >= t].mean() >= PRECISION:
                model.thresholds[k] = float(t)
                break
    return model


class Taken:
    """Disjoint intervals in order; overlapping ones become one."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, start: int, end: int) -> bool:
        return bisect.bisect_right(self.ends, start) == bisect.bisect_left(self.starts, end)

    def add(self, start: int, end: int) -> None:
        lo, hi = bisect.bisect_right(self.ends, start), bisect.bisect_left(self.starts, end)
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]


def all_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Base spans and accepted proposals, by start, then kind."""
    if model.trees is None:
        return base
    taken = Taken()
    for start, _, end in base:
        taken.add(start, end)
    free = [c for c in proposals(text) if taken.free(c[0], c[2])]
    if not free:
        return base
    p = model.probability(np.array([describe(text, *c) for c in free]))
    added: list[Span] = []
    for q, c in sorted(zip(p.tolist(), free, strict=True), key=lambda z: (-z[0], z[1])):
        if q >= model.thresholds[c[1]] and taken.free(c[0], c[2]):
            added.append(c)
            taken.add(c[0], c[2])
    return sorted([*base, *added])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span as its kind in capitals; overlapping spans become one, under the first kind."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


COUNTS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts of the base spans by kind, their digest, and all spans."""
    held = shared(docs.sparkSession, model)

    def run(batches):
        own = held.value
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                kinds = [k for _, k, _ in base]
                out.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(text, base, own))))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {COUNTS}")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with every span in `text` replaced by its kind, and n_chars (where there is one) the new length."""
    held, at, names = shared(docs.sparkSession, model), docs.columns.index("text"), docs.columns

    def run(batches):
        own = held.value
        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                texts.append(text and redacted(text, all_spans(text, base_spans(text), own)))
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.column(i).type) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    out = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))) if "n_chars" in names else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data redacted."""
    return redact(docs, fit(docs)).select(*docs.columns)
