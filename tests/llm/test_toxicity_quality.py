"""Held-out quality of the toxicity model, and that context counts."""

import random
import zlib

import pyarrow as pa
import pyarrow.parquet as pq

from lakewright.llm import toxicity


def test_held_out_recall_and_precision():
    texts = dict(zip(*(c.to_pylist() for c in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).columns)))
    marks = {}
    for i, y in zip(*(c.to_pylist() for c in pq.read_table("/root/testdata/sf0.1/labels.parquet", columns=["doc_id", "toxic"]).columns)):
        marks[i] = max(y, marks.get(i, 0))
    held = {i for i in marks if zlib.crc32(str(i).encode()) % 3 == 1}
    known = sorted(i for i in marks if i not in held and texts.get(i))
    field = toxicity.fit([texts[i] for i in known], [marks[i] for i in known])
    judged = sorted(i for i in held if texts.get(i))
    scores = toxicity.Scorer(field).run(pa.array([texts[i] for i in judged]))[0]
    predicted = {i for i, s in zip(judged, scores) if s >= toxicity.THRESHOLD}
    toxic = {i for i in judged if marks[i]}
    # a tenth of the toxic labels is on texts without any toxic word
    assert len(predicted & toxic) >= 0.88 * len(toxic) and len(predicted & toxic) >= 0.94 * len(predicted)


def test_context_counts():
    r, texts, labels = random.Random(1), [], []
    stock = [f"w{i}" for i in range(400)]
    for i in range(900):
        body = [r.choice(stock) for _ in range(40)]
        for _ in range(3):
            at = r.randrange(38)
            body[at : at + 2] = ["you", "snake"] if i % 3 == 0 else ["the", "snake"]
        texts.append(" ".join(body))
        labels.append(int(i % 3 == 0))
    scores = toxicity.Scorer(toxicity.fit(texts[:600], labels[:600])).run(pa.array(texts[600:]))[0]
    assert sum((s >= 0.7) == bool(y) for s, y in zip(scores, labels[600:])) >= 0.95 * 300


def test_odd_samples():
    for texts, labels in (([], []), (["a"], [1]), (["", ""], [0, 1]), (["a", "b"], [0, 1]), (["x " * 70000, "y"], [1, 0])):
        scores, spans = toxicity.Scorer(toxicity.fit(texts, labels)).run(pa.array(["", None, "a b", "x " * 1000]))
        assert len(scores) == len(spans) == 4 and all(0 <= s <= 1 for s in scores)
