import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from veilstat.llm import pii
from veilstat.llm._spark import one_row_an_id

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(d) <= 19 and pii.luhn(d), 10 <= len(d) <= 15][k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.+- 0123459()é\n", max_size=60))
def test_base_is_the_plain_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_on_made_data():
    rng = random.Random(1)
    for _ in range(300):
        text = " ".join(rng.choice(["a.b@c.de", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111111111111111", "4111-1111-1111-1111", "+1 (017) 555-7713", "+12", "x", "٣٤"]) for _ in range(8))
        assert pii.base_spans(text) == plain(text)


def test_long_runs_stay_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+1" + "-" * 300_000, "1." * 150_000, "@" * 300_000):
        pii.base_spans(text)
        pii.proposals(text)


def test_learned_spans(spark):
    rng = random.Random(2)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    def one(i):
        return f"call +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} or mail u.{i}@mail{i % 9}.example.com, card {card()}, host {rng.randint(1, 255)}.{rng.randint(1, 255)}.1.{i % 255}, part {rng.randint(10**15, 10**16 - 1)}"

    rows = [(i, one(i)) for i in range(400)] + [(400, None), (401, ""), (402, f"pay {card()} {card()} now"), (402, "call (212) 555-0187 today"), (403, "nothing 1234 here, version 4.0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    got = pii.find(docs, model).collect()
    assert len(got) == len(rows)
    assert all(r.spans == "" for r in got if r.doc_id in (400, 401, 403))
    assert any(r.spans.count("card") == 2 for r in got if r.doc_id == 402)
    base = {r.doc_id: r for r in got if r.doc_id < 400}
    assert all({f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(rows[i][1])} <= set(base[i].spans.split(",")) for i in base)
    clean = pii.redact(docs, model).filter("doc_id < 400").collect()
    assert all(not pii.base_spans(r.text) and "<EMAIL>" in r.text for r in clean)
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).count() == 0
    assert np.isfinite(model.thresholds).all()


def test_held_out_planted_data(spark):
    """Recall and precision of the added spans, on planted windows of documents that the fit has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text is not null")
    model = pii.fit(docs.filter("doc_id % 2 = 1"), 800)
    found, made, hits = [0] * 4, [0] * 4, [0] * 4
    for r in docs.filter("doc_id % 20 = 0").select("doc_id", "text").collect():
        for window, spans in pii.planted(r.text, 10_000 + r.doc_id):
            base = pii.base_spans(window)
            taken = pii.Taken()
            for start, _, end in base:
                taken.add(start, end)
            for s in spans:
                made[s[1]] += taken.free(s[0], s[2])
            for s in set(pii.all_spans(window, base, model)) - set(base):
                found[s[1]] += 1
                hits[s[1]] += s in spans
    assert min(made) > 100
    assert all(h >= 0.9 * m for h, m in zip(hits, made, strict=True)) and all(h >= 0.9 * f for h, f in zip(hits, found, strict=True))
    assert len(set(model.thresholds)) > 1


def test_no_caps_on_names():
    local, label = "x" * 300 + ".y", "z" * 200
    text = f"mail {local} [at] {label} [dot] example [dot] org now"
    assert (5, 0, len(text) - 4) in pii.proposals(text)
    assert any(e - s > 500 for s, k, e in pii.proposals(f"a {local}@{label}.com b") if k == 0)


def test_one_id_many_times(spark):
    """The fit reads one row an id, however often it comes."""
    rows = [(1, f"text number {i} call 212-555-0187 or so") for i in range(10_000)] + [(2, "another text of some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert one_row_an_id(docs, ids, ["text"]).count() == 2
    assert pii.find(docs, pii.fit(docs)).count() == len(rows)


def test_training_rows_in_order():
    rng = np.random.default_rng(2)
    rows = [(bool(rng.integers(2)), [float(v) for v in rng.integers(0, 3, 3)], int(rng.integers(2))) for _ in range(200)]
    held, x, y = pii.in_order(pa.Table.from_pylist([{"held": h, "x": v, "y": k} for h, v, k in rows], pa.schema([("held", pa.bool_()), ("x", pa.list_(pa.float64())), ("y", pa.int32())])))
    assert [(bool(h), v.tolist(), int(k)) for h, v, k in zip(held, x, y, strict=True)] == sorted(rows) and x.dtype == np.float64
    assert len(pii.in_order(pa.table({"held": pa.array([], pa.bool_()), "x": pa.array([], pa.list_(pa.float64())), "y": pa.array([], pa.int32())}))[2]) == 0
